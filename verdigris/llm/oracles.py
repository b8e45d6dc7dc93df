"""DuckDB SQL for the queries that SQL can express."""

from verdigris.llm.url_filter import TWO_LABEL_SUFFIXES

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT rid, s, n, item FROM dw JOIN bw USING (win, n)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""

HOST_REPUTATION = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) END AS rest FROM pages
), seen AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), outcome AS (
  SELECT host, bad
  FROM (SELECT host, CAST(nullif(regexp_extract(path, '/(\d{1,18})', 1), '') AS BIGINT) AS doc_id FROM seen)
  JOIN (SELECT doc_id, max(CAST(toxic = 1 OR quality = 0 AS INT)) AS bad FROM labels GROUP BY doc_id) USING (doc_id)
  WHERE bad IS NOT NULL
), named AS (
  SELECT host, bare, array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') AS two, regexp_matches(bare, '^\d+\.\d+\.\d+\.\d+$|^\[') AS address
  FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare FROM seen)
), h AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(o.bad, 0) AS bad,
         CASE WHEN address THEN bare WHEN two IN (TWO_LABEL_SUFFIXES) THEN array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.') ELSE two END AS domain,
         CASE WHEN address THEN bare WHEN two IN (TWO_LABEL_SUFFIXES) THEN two ELSE list_extract(string_split(bare, '.'), -1) END AS suffix
  FROM named LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS bad FROM outcome GROUP BY host) o USING (host)
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
t AS (
  SELECT lvl, sum(n)::DOUBLE AS nn, sum(bad)::DOUBLE AS bb, count(*)::DOUBLE AS g, sum(n * n)::DOUBLE AS q, sum(bad::DOUBLE * bad / n) AS ss
  FROM (SELECT 'h' AS lvl, n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s) WHERE n > 0 GROUP BY lvl
), m AS (SELECT *, (bb + 0.5) / (nn + 1) AS m FROM t),
v AS (SELECT *, ss - 2 * m * bb + m * m * nn - m * (1 - m) * (g - 1) AS beyond, m * (1 - m) * (nn - q / nn - (g - 1)) AS room FROM m),
k AS (SELECT lvl, m, CASE WHEN g > 1 AND room > 0 AND beyond / room > 0 THEN greatest(2.0, least(1000.0, room / beyond - 1)) ELSE 1000.0 END AS k FROM v),
sr AS (SELECT suffix, (bad + k * m) / (n + k) AS rate FROM s, k WHERE lvl = 's'),
dr AS (SELECT domain, suffix, (bad + k * rate) / (n + k) AS rate FROM d JOIN sr USING (suffix), k WHERE lvl = 'd'),
hr AS (SELECT host, bad + k * rate AS a, n - bad + k * (1 - rate) AS b FROM h JOIN dr USING (domain, suffix), k WHERE lvl = 'h'),
blocked AS (SELECT host FROM hr WHERE a / (a + b) - 1.645 * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) > 0.5),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, rhost, rpath)),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS said
  FROM seen JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT seen.page_id, seen.host, seen.path, fit.rule, coalesce(fit.said, CASE WHEN blocked.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM seen LEFT JOIN fit USING (page_id) LEFT JOIN blocked ON seen.host = blocked.host
""".replace("TWO_LABEL_SUFFIXES", ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES))

LIKELIHOOD_RATIO = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
crc AS (
  SELECT doc_id, min(quality) AS least,
         xor(list_reduce(list_transform(range(1, length(any_value(s)) + 1), lambda i: ord(any_value(s)[i])::BIGINT),
             lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295) AS crc
  FROM (SELECT doc_id, quality, CAST(doc_id AS VARCHAR) AS s FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL) GROUP BY doc_id
), good AS (SELECT doc_id FROM crc WHERE least = 1 AND crc % 5 <> 0),
words AS (SELECT rid, i, w[i] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
h AS (SELECT rid, i, word, (md5_number_lower(word) % 2147483647)::BIGINT AS h FROM words),
g AS (
  SELECT rid, h % 20011 AS bucket FROM h
  UNION ALL
  SELECT rid, (before * 1000003 + h + 1) % 20011 FROM (SELECT rid, h, lag(h) OVER (PARTITION BY rid ORDER BY i) AS before FROM h) WHERE before IS NOT NULL
), c AS (
  SELECT bucket, count(*) AS r, count(*) FILTER (rid IN (SELECT rid FROM d WHERE doc_id IN (SELECT doc_id FROM good))) AS t FROM g GROUP BY bucket
), n AS (SELECT sum(r)::DOUBLE AS rr, sum(t)::DOUBLE AS tt FROM c),
weight AS (
  SELECT bucket, CASE WHEN tt = 0 THEN 0 ELSE floor(ln(((t + 80044 * share) / (tt + 80044)) / share) * 1048576 + 0.5)::BIGINT END AS weight
  FROM (SELECT bucket, t, tt, (r + 1.0::DOUBLE) / (rr + 20011) AS share FROM c, n)
), score AS (SELECT rid, count(*) AS n_grams, sum(weight) AS total FROM g JOIN weight USING (bucket) GROUP BY rid),
win AS (SELECT rid, i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o) AS win, lead(word, 2) OVER o IS NOT NULL AS whole FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS times FROM win WHERE whole) WHERE times > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(3) x(k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND total >= -83887 * n_grams AS kept
FROM m LEFT JOIN score USING (rid)
"""


def _product_codes(rounds: int = 2) -> str:
    nearest = """
b{k} AS (
  SELECT rid, part, min({{'error': error, 'entry': entry}}) AS best
  FROM (SELECT rid, p.part, entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS error FROM p JOIN c{k} c ON p.part = c.part)
  GROUP BY rid, part
)"""
    moved = """
c{n} AS (
  SELECT part, entry, coalesce(mean, x) AS x FROM c{k} LEFT JOIN (
    SELECT part, entry, list(floor(total::DOUBLE / n)::BIGINT ORDER BY i) AS mean
    FROM (SELECT p.part, best.entry AS entry, i, sum(x[i])::BIGINT AS total, count(*) AS n FROM p JOIN b{k} USING (rid, part), range(1, 1000) r(i) WHERE i <= len(x) GROUP BY ALL)
    GROUP BY part, entry) USING (part, entry)
)"""
    steps = []
    for k in range(rounds):
        steps += [nearest.format(k=k), moved.format(n=k + 1, k=k)]
    last = f"c{rounds}"
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT rid, part, list_slice(x, part * (len(x) // 16) + 1, (part + 1) * (len(x) // 16)) AS x FROM v, range(16) r(part)),
f AS (SELECT vec_id, min(x) AS x FROM v WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 64),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, list_slice(x, part * (len(x) // 16) + 1, (part + 1) * (len(x) // 16)) AS x FROM f, range(16) r(part)),
{",".join(steps)}, {nearest.format(k=rounds)},
coded AS (SELECT rid, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, sum(best.error)::BIGINT AS error FROM b{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM {last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM v JOIN coded USING (rid), books
"""


PRODUCT_CODES = _product_codes()
