"""Queries and SQL: text measures, similarity, consistency, verification, bias, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import similarity as S
from verdigris.functions import text as X
from verdigris.functions.storage import checkpoint
from verdigris.operators import bias, consistency, search, verification
from verdigris.plans.fixtures import claims, references, table, turns

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


SYL = "list_sum(list_transform(regexp_extract_all(text, '([A-Za-z]+(?:''[A-Za-z]+)*)', 1), lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 AND lower(x) LIKE '%e' THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(x), '[^aeiouy]le$') THEN 1 ELSE 0 END)))"
SENT = "len(list_filter(string_split(trim(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g')), chr(1)), lambda s: trim(s) <> ''))"
WORDS = "len(regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’.][\\p{L}\\p{N}]+)*'))"
MEASURES = f"WITH d AS (SELECT doc_id AS id, {WORDS} AS words, {SENT} AS sentences, CAST(coalesce({SYL}, 0) AS INT) AS syllables FROM documents)"


def measures(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("id", X.word_count(t).alias("words"), F.size(X.sentences(t)).alias("sentences"), X.syllable_total(t).alias("syllables"))


@query("TXT1_syllables", MEASURES + " SELECT id, syllables FROM d")
def txt1(spark, sf):
    return measures(spark, sf).select("id", "syllables")


@query("TXT2_sentences", MEASURES + " SELECT id, CAST(sentences AS INT) AS sentences FROM d")
def txt2(spark, sf):
    return measures(spark, sf).select("id", "sentences")


@query("TXT3_word_count", MEASURES + " SELECT id, CAST(words AS INT) AS words FROM d")
def txt3(spark, sf):
    return measures(spark, sf).select("id", "words")


@query(
    "TXT4_readability",
    MEASURES
    + """ SELECT id, round(CASE WHEN words = 0 OR sentences = 0 THEN 0.0 ELSE 206.835 - 1.015 * words::DOUBLE / sentences - 84.6 * syllables::DOUBLE / words END, 6) AS flesch_ease,
      round(CASE WHEN words = 0 OR sentences = 0 THEN 0.0 ELSE 0.39 * words::DOUBLE / sentences + 11.8 * syllables::DOUBLE / words - 15.59 END, 6) AS flesch_kincaid,
      round(CASE WHEN sentences = 0 THEN 0.0 ELSE words::DOUBLE / sentences END, 6) AS avg_sentence FROM d""",
)
def txt4(spark, sf):
    w, s, y = F.col("words"), F.col("sentences"), F.col("syllables")
    return measures(spark, sf).select(
        "id", F.round(X.flesch_ease(w, s, y), 6).alias("flesch_ease"), F.round(X.flesch_kincaid(w, s, y), 6).alias("flesch_kincaid"), F.round(F.when(s == 0, 0.0).otherwise(w / s), 6).alias("avg_sentence")
    )


def marker_sql(kind: str) -> str:
    return "CAST(" + " + ".join(f"len(regexp_extract_all(lower(text), '\\b{m}\\b'))" for m in X.MARKERS[kind]) + f" AS INT) AS {kind}"


@query("TXT7_discourse_markers", f"SELECT doc_id AS id, {', '.join(map(marker_sql, X.MARKERS))} FROM documents")
def txt7(spark, sf):
    return documents(spark, sf).select("id", *[c.alias(k) for k, c in X.marker_counts(F.col("text")).items()])


@query("TXT13_task_type", "SELECT doc_id AS id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in marks) + f" THEN '{k}'" for k, marks in X.TASKS) + " ELSE 'general' END AS task FROM documents")
def txt13(spark, sf):
    return documents(spark, sf).select("id", X.task_type(F.col("text")).alias("task"))


@query(
    "TXT15_token_estimates",
    """SELECT doc_id AS id, CAST(greatest(strlen(text) // 4, 1) AS BIGINT) AS by_bytes, CAST(ceil(length(text) / 4.0) AS BIGINT) AS by_chars,
      CAST(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS BIGINT) AS by_words FROM documents""",
)
def txt15(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("id", X.token_estimate_bytes(t).alias("by_bytes"), X.token_estimate_chars(t).alias("by_chars"), X.token_estimate_words(t).alias("by_words"))


@query(
    "TXT27_failure_classifier",
    """WITH e AS (SELECT event_id, event_type || ' ' || CASE event_id % 6 WHEN 0 THEN 'request timeout' WHEN 1 THEN 'network down' WHEN 2 THEN 'blocked by filter' WHEN 3 THEN 'malformed' ELSE 'odd' END AS message,
      CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 401 END AS status FROM events)
    SELECT event_id, CASE WHEN message LIKE '%timeout%' OR message LIKE '%aborted%' THEN 'timeout' WHEN status = 429 OR message LIKE '%rate limit%' THEN 'rate_limited' WHEN status IN (401, 403) THEN 'authentication_error'
      WHEN status >= 500 THEN 'server_error' WHEN message LIKE '%network%' OR message LIKE '%connect%' THEN 'connection_error' WHEN message LIKE '%filter%' OR message LIKE '%blocked%' OR message LIKE '%safety%' THEN 'content_filtered'
      WHEN message LIKE '%invalid%' OR message LIKE '%malformed%' THEN 'invalid_response' ELSE 'unknown' END AS mode FROM e""",
)
def txt27(spark, sf):
    k, s = F.col("event_id") % 6, F.col("event_id") % 5
    said = F.when(k == 0, "request timeout").when(k == 1, "network down").when(k == 2, "blocked by filter").when(k == 3, "malformed").otherwise("odd")
    status = F.when(s == 0, 429).when(s == 1, 503).when(s == 2, 401)
    return table(spark, sf, "events").select("event_id", X.failure_mode(F.concat_ws(" ", "event_type", said), status).alias("mode"))


@query("TXT29_hashes", "SELECT doc_id AS id, sha256(text) AS inputs_hash, substring(sha256(text), 1, 16) AS prompt_hash FROM documents")
def txt29(spark, sf):
    return documents(spark, sf).select("id", F.sha2("text", 256).alias("inputs_hash"), F.substring(F.sha2("text", 256), 1, 16).alias("prompt_hash"))


@query("TXT14_template_render", "SELECT c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment || ', {{missing}}' AS rendered, 3 AS placeholders FROM customer")
def txt14(spark, sf):
    template = F.lit("Dear {{name}} of {{segment}}, {{missing}}")
    variables = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", X.render(template, variables).alias("rendered"), F.size(X.placeholders(template)).alias("placeholders"))


# similarity

NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
TURNS = f"WITH t AS (SELECT conv_id AS group_id, turn AS ordinal, text, {NORM} AS norm FROM conversations), p AS (SELECT a.group_id, a.ordinal AS i, b.ordinal AS j, a.text AS a, b.text AS b, a.norm AS na, b.norm AS nb FROM t a JOIN t b ON a.group_id = b.group_id AND a.ordinal < b.ordinal)"


def char_grams_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda k: substring({x}, CAST(k AS INT), {n}))) ELSE [] END"


def word_grams_sql(x: str, n: int) -> str:
    return f"CASE WHEN len(string_split({x}, ' ')) >= {n} THEN list_distinct(list_transform(range(1, len(string_split({x}, ' ')) - {n} + 2), lambda k: array_to_string(list_slice(string_split({x}, ' '), k, k + {n} - 1), ' '))) ELSE [] END"


def jaccard_sql(a: str, b: str, empty: str = "1.0") -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN {empty} ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


#: DuckDB's edit distance compares bytes: letters beyond ASCII that the tables have are made single ones.
FLAT = "translate({}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', " + " || ".join(f"chr({k})" for k in (*range(1, 9), 11, 12, *range(14, 25))) + ")"
EDITS = f"levenshtein({FLAT.format('{0}')}, {FLAT.format('{1}')})"
ALIKE = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 ELSE 1 - " + EDITS + " / greatest(length({0}), length({1}))::DOUBLE END"


@query(
    "SIM1_pair_similarities",
    TURNS
    + f""", g AS (SELECT group_id, {char_grams_sql('na', 3)} AS ca, {char_grams_sql('nb', 3)} AS cb, {word_grams_sql('na', 2)} AS wa, {word_grams_sql('nb', 2)} AS wb, na = nb AS same, {ALIKE.format('na', 'nb')} AS ed FROM p)
    SELECT group_id, count(*) AS pairs, bool_and(same) AS all_equal, round(avg(ed), 6) AS levenshtein, round(avg({jaccard_sql('ca', 'cb')}), 6) AS char_3gram, round(avg({jaccard_sql('wa', 'wb')}), 6) AS word_2gram FROM g GROUP BY group_id""",
)
def sim1(spark, sf):
    return consistency.pair_similarity(turns(spark, sf))


@query(
    "SIM4_ngram_jaccard",
    TURNS
    + f""", g AS (SELECT group_id, {char_grams_sql('na', 3)} AS ca, {char_grams_sql('nb', 3)} AS cb, {word_grams_sql('na', 2)} AS wa, {word_grams_sql('nb', 2)} AS wb, na = nb AS same FROM p)
    SELECT group_id, count(*) AS pairs, bool_and(same) AS all_equal, round(avg({jaccard_sql('ca', 'cb')}), 6) AS char_3gram, round(avg({jaccard_sql('wa', 'wb')}), 6) AS word_2gram FROM g GROUP BY group_id""",
)
def sim4(spark, sf):
    return consistency.set_similarity(turns(spark, sf))


@query(
    "SIM3_group_jaccard",
    """WITH t AS (SELECT conv_id AS group_id, turn, unnest(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS token FROM conversations),
    n AS (SELECT conv_id AS group_id, count(*) AS n FROM conversations GROUP BY 1), c AS (SELECT group_id, token, count(*) AS k FROM t GROUP BY ALL), s AS (SELECT group_id, count(*) FILTER (k = n) AS in_all, count(*) AS in_any FROM c JOIN n USING (group_id) GROUP BY 1)
    SELECT group_id, round(coalesce(in_all / in_any::DOUBLE, 1.0), 6) AS jaccard FROM n LEFT JOIN s USING (group_id)""",
)
def sim3(spark, sf):
    return consistency.group_jaccard(turns(spark, sf))


@query(
    "SIM6_tfidf_cosine",
    """WITH w AS (SELECT conv_id AS g, turn AS o, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations), n AS (SELECT conv_id AS g, count(*) AS n FROM conversations GROUP BY 1),
    tf AS (SELECT g, o, word, count(*) AS c, any_value(l) AS l FROM (SELECT g, o, len(w) AS l, unnest(w) AS word FROM w) GROUP BY g, o, word), df AS (SELECT g, word, count(*) AS df FROM tf GROUP BY ALL),
    x AS (SELECT g, o, word, c / l::DOUBLE * (ln((n + 1) / (df + 1)::DOUBLE) + 1) AS x FROM tf JOIN df USING (g, word) JOIN n USING (g)), nm AS (SELECT g, o, sqrt(sum(x * x)) AS nrm FROM x GROUP BY ALL),
    u AS (SELECT g, o, word, x / nrm AS x FROM x JOIN nm USING (g, o)), s AS (SELECT a.g, sum(a.x * b.x) AS total FROM u a JOIN u b ON a.g = b.g AND a.word = b.word AND a.o < b.o GROUP BY 1)
    SELECT g AS group_id, round(CASE WHEN n * (n - 1) / 2 > 0 THEN coalesce(total, 0.0) / (n * (n - 1) / 2.0) ELSE 1.0 END, 6) AS cosine FROM n LEFT JOIN s USING (g)""",
)
def sim6(spark, sf):
    return consistency.tfidf_cosine(turns(spark, sf))


SPACE = "list_distinct(regexp_split_to_array(lower({}), '\\s+'))"
AVERAGE = TURNS + f""", s AS (SELECT group_id, i, j, {jaccard_sql(SPACE.format('a'), SPACE.format('b'), '0.0')} AS s FROM p), b AS (SELECT group_id, i AS ordinal, s FROM s UNION ALL SELECT group_id, j, s FROM s),
  av AS (SELECT group_id, ordinal, round(avg(s), 6) AS similarity FROM b GROUP BY ALL)"""


@query("JN8_average_similarity", AVERAGE + " SELECT * FROM av")
def jn8(spark, sf):
    return consistency.average_similarity(turns(spark, sf))


@query("WIN18_outliers", AVERAGE + " SELECT group_id, arg_min(ordinal, (-similarity, ordinal)) AS representative, arg_min(ordinal, (similarity, ordinal)) AS divergent FROM av GROUP BY group_id")
def win18(spark, sf):
    return consistency.outliers(turns(spark, sf))


def bands_sql(score: str, bands, rest: str) -> str:
    out, above = [], "FALSE"
    for name, least in bands:
        out.append(f"count(*) FILTER ({score} >= {least}::DOUBLE AND NOT {above}) AS {name}")
        above = f"({score} >= {least}::DOUBLE)"
    return ", ".join([*out, f"count(*) FILTER (NOT {above}) AS {rest}"])


@query("AGG12_consistency_bands", AVERAGE + f" SELECT count(*) AS n, round(avg(similarity), 6) AS mean, round(stddev_pop(similarity), 6) AS sd, {bands_sql('similarity', consistency.CONSISTENCY_BANDS, 'highly_inconsistent')} FROM av")
def agg12(spark, sf):
    return consistency.banded(consistency.average_similarity(turns(spark, sf)), [], "similarity", consistency.CONSISTENCY_BANDS, "highly_inconsistent")


SPREAD = ", ".join(f"round(avg({c}), 6) AS avg_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}, round(stddev_pop({c}), 6) AS sd_{c}, round(CASE WHEN avg({c}) > 0 THEN stddev_pop({c}) / avg({c}) ELSE 0 END, 6) AS cv_{c}" for c in ("words", "chars"))


@query(
    "SIM19_spread",
    TURNS
    + f""", z AS (SELECT group_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INT) AS words, CAST(length(text) AS INT) AS chars FROM t), s AS (SELECT group_id, {SPREAD} FROM z GROUP BY group_id),
    e AS (SELECT group_id, round(avg({EDITS.format('a', 'b')}), 6) AS avg_edits, CAST(max({EDITS.format('a', 'b')}) AS INT) AS max_edits FROM p GROUP BY group_id) SELECT s.*, avg_edits, max_edits FROM s LEFT JOIN e USING (group_id)""",
)
def sim19(spark, sf):
    return consistency.spread(turns(spark, sf))


@query("SIM2_levenshtein", TURNS + f" SELECT group_id, i, j, round({ALIKE.format('a', 'b')}, 6) AS similarity FROM p")
def sim2(spark, sf):
    p = consistency.pair_measure(turns(spark, sf), consistency.edit_likeness, "similarity")
    return p.withColumn("similarity", F.round("similarity", 6))


@query("SIM16_word_error_rate")
def sim16(spark, sf):
    p = consistency.pairs(turns(spark, sf))
    p = S.with_word_error_rate(p, "a", "b", "wer")
    return p.select("group_id", "i", "j", F.round("wer", 6).alias("wer"), F.round(S.character_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


KW = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-zA-Z0-9_]+'), lambda w: length(w) > 2))"
STRIP = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-zA-Z0-9_\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 2))"


@query(
    "SIM9_token_similarities",
    TURNS
    + f""", k AS (SELECT group_id, i, j, a, b, {KW.format('a')} AS ka, {KW.format('b')} AS kb, {STRIP.format('a')} AS sa, {STRIP.format('b')} AS sb FROM p)
    SELECT group_id, i, j, round({jaccard_sql('ka', 'kb')}, 6) AS keyword, round(CASE WHEN len(ka) = 0 THEN 0.0 ELSE len(list_intersect(ka, kb))::DOUBLE / len(ka) END, 6) AS coverage,
      round(CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0 ELSE {jaccard_sql('sa', 'sb')} END, 6) AS token FROM k""",
)
def sim9(spark, sf):
    a, b = F.col("a"), F.col("b")
    p = consistency.pairs(turns(spark, sf))
    return p.select("group_id", "i", "j", F.round(S.keyword_jaccard(a, b), 6).alias("keyword"), F.round(S.keyword_coverage(a, b), 6).alias("coverage"), F.round(S.token_jaccard(a, b), 6).alias("token"))


@query(
    "SIM8_weighted_ngrams",
    TURNS
    + ", g AS (SELECT group_id, i, j, lower(a) AS x, lower(b) AS y, " + ", ".join(f"{char_grams_sql('lower(a)', n)} AS a{n}, {char_grams_sql('lower(b)', n)} AS b{n}" for n in (2, 3, 4, 5)) + " FROM p), "
    + "s AS (SELECT *, " + " + ".join(f"CASE WHEN len(a{n}) > 0 AND len(b{n}) > 0 THEN {w}::DOUBLE * {jaccard_sql(f'a{n}', f'b{n}')} ELSE 0 END" for n, w in ((2, .2), (3, .3), (4, .3), (5, .2))) + " AS top, "
    + " + ".join(f"CASE WHEN len(a{n}) > 0 AND len(b{n}) > 0 THEN {w}::DOUBLE ELSE 0 END" for n, w in ((2, .2), (3, .3), (4, .3), (5, .2))) + " AS bottom FROM g) "
    + "SELECT group_id, i, j, round(CASE WHEN x = y THEN 1.0 WHEN bottom > 0 THEN top / bottom ELSE 0.0 END, 6) AS similarity FROM s",
)
def sim8(spark, sf):
    p = consistency.pair_measure(turns(spark, sf).withColumn("content", F.lower("content")), S.weighted_ngrams, "similarity")
    return p.withColumn("similarity", F.round("similarity", 6))


@query(
    "SIM18_vector_similarity",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0) SELECT query_id, vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine, round(list_distance(q::DOUBLE[], embedding::DOUBLE[]), 6) AS euclidean,
      round(list_inner_product(q::DOUBLE[], embedding::DOUBLE[]), 6) AS dot FROM q, embeddings WHERE round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) >= 0.2""",
)
def sim18(spark, sf):
    """Every vector whose id is divisible by 20 against all vectors."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.similar_vectors(vectors, queries, 0.2)


# verification


CLAIMS = "cl AS (SELECT conv_id || '-' || turn AS claim_id, text AS claim FROM conversations), rf AS (SELECT item_id AS reference_id, text AS reference FROM benchmark)"
NEG = "regexp_matches(lower({}), '\\b(?:not|never|no|without|can''t|cannot|won''t|doesn''t|don''t|isn''t|aren''t|wasn''t|weren''t)\\b')"
EVIDENCE = f"""WITH {CLAIMS}, c AS (SELECT claim_id, {KW.format('claim')} AS ck, {char_grams_sql('lower(claim)', 3)} AS cg, {NEG.format('claim')} AS cn FROM cl),
  r AS (SELECT reference_id, {KW.format('reference')} AS rk, {char_grams_sql('lower(reference)', 3)} AS rg, {NEG.format('reference')} AS rn FROM rf),
  b AS (SELECT claim_id, reference_id, CASE WHEN len(ck) > 0 THEN len(list_intersect(ck, rk))::DOUBLE / len(ck) ELSE 0.0 END AS coverage, CASE WHEN len(cg) = 0 OR len(rg) = 0 THEN 0.0 ELSE {jaccard_sql('cg', 'rg')} END AS alike, cn <> rn AS x FROM c, r),
  e AS (SELECT claim_id, reference_id, coverage, alike, coverage * 0.4 + alike * 0.6 AS similarity, x AND alike > 0.3 AS contradicts FROM b)"""
HALLUCINATIONS = EVIDENCE + """, o AS (SELECT claim_id, max(similarity) AS s, bool_or(contradicts) AS con, avg(1 - coverage) AS unmatched, count(*) AS n, avg(similarity) AS mean, var_pop(similarity) AS v, arg_min(reference_id, (-round(similarity, 9), reference_id)) AS best FROM e GROUP BY claim_id),
  k AS (SELECT *, CASE WHEN con THEN 'contradiction' WHEN s < 0.2 THEN 'fabrication' WHEN s < 0.4 THEN 'unsupported' WHEN s < 0.7 THEN 'partial_support' WHEN unmatched > 0.4 THEN 'exaggeration' END AS type FROM o),
  h AS (SELECT claim_id, round(s, 6) AS support, type, CASE type WHEN 'contradiction' THEN 'critical' WHEN 'fabrication' THEN CASE WHEN s < 0.1 THEN 'critical' ELSE 'high' END WHEN 'exaggeration' THEN CASE WHEN s < 0.5 THEN 'medium' ELSE 'low' END
    WHEN 'unsupported' THEN CASE WHEN s < 0.3 THEN 'high' ELSE 'medium' END WHEN 'partial_support' THEN 'low' END AS severity,
    round((1 - least(1.0, v * 4)) * 0.3 + CASE WHEN type IN ('fabrication', 'contradiction') THEN 0.9 WHEN type = 'unsupported' THEN 0.7 WHEN type IS NOT NULL THEN 0.6 WHEN mean > 0.8 THEN 0.9 ELSE 0.75 END * 0.5 + least(1.0, n / 3.0) * 0.2, 6) AS confidence,
    CASE WHEN s > 0 THEN best END AS best_reference FROM k)"""


@query("JN5_claim_evidence", EVIDENCE + " SELECT claim_id, reference_id, round(coverage, 9) AS coverage, round(alike, 9) AS alike, round(similarity, 9) AS similarity, contradicts FROM e")
def jn5(spark, sf):
    return verification.evidence(claims(spark, sf), references(spark, sf)).withColumns({c: F.round(c, 9) for c in ("coverage", "alike", "similarity")})


@query("TXT19_hallucinations", HALLUCINATIONS + " SELECT * FROM h")
def txt19(spark, sf):
    return verification.hallucinations(verification.support(claims(spark, sf), references(spark, sf)))


@query(
    "AGG14_hallucination_stats",
    HALLUCINATIONS
    + " SELECT count(*) AS claims, count(type) AS hallucinated, round(count(type) / count(*)::DOUBLE, 6) AS rate, round(avg(support), 6) AS avg_support, "
    + ", ".join(f"count(*) FILTER (type = '{k}') AS {k}" for k in ("contradiction", "fabrication", "unsupported", "partial_support", "exaggeration"))
    + ", " + ", ".join(f"count(*) FILTER (severity = '{k}') AS severity_{k}" for k in ("low", "medium", "high", "critical")) + " FROM h",
)
def agg14(spark, sf):
    return verification.hallucination_stats(verification.hallucinations(verification.support(claims(spark, sf), references(spark, sf))))


def sentences_of_turns(spark, sf):
    t = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return verification.claim_sentences(t)


SENTENCES = """WITH s AS (SELECT conv_id || '-' || turn AS id, regexp_extract_all(text, '([^.!?]*[.!?]+|[^.!?]+$)', 1) AS s FROM conversations),
  p AS (SELECT id, flatten(list_transform(s, lambda x: regexp_split_to_array(trim(x), '(?i),\\s*(?:and|but|or|however|although)\\s+|;\\s*'))) AS p FROM s),
  k AS (SELECT id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 10) AS k FROM p),
  sc AS (SELECT id, unnest(range(0, len(k))) AS place, unnest(k) AS claim FROM k)"""
TYPE = "CASE " + " ".join("WHEN regexp_matches(lower(claim), '%s') THEN '%s'" % (p, k) for k, p in verification.CLAIM_TYPES) + " ELSE 'factual' END"


@query("TXT20_claims", SENTENCES + f" SELECT id, CAST(place AS INT) AS place, claim, {TYPE} AS type FROM sc")
def txt20(spark, sf):
    return sentences_of_turns(spark, sf).withColumn("type", verification.claim_type(F.col("claim")))


def source_sentences(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return verification.claim_sentences(b, atomic=False).select(F.concat_ws("-", "id", "place").alias("source_id"), F.col("claim").alias("sentence"))


def numbered(spark, sf):
    return sentences_of_turns(spark, sf).select(F.concat_ws("-", "id", "place").alias("claim_id"), "claim")


NEGATED = "len(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w IN (" + ", ".join("'%s'" % w.replace("'", "''") for w in verification.NEGATION_WORDS) + "))) > 0"
NUMBERS = "list_transform(regexp_extract_all({}, '(\\d+(?:\\.\\d+)?)', 1), lambda x: CAST(x AS DOUBLE))"
DISAGREE = "len(list_filter(x, lambda u: len(list_filter(y, lambda v: abs(u - v) / greatest(u, v, 1.0) > 0.1 AND abs(u - v) / greatest(u, v, 1.0) < 1)) > 0)) > 0"
SUPPORTS = SENTENCES + f""", cl AS (SELECT id || '-' || place AS claim_id, claim, {STRIP.format('claim')} AS ct, {NEGATED.format('claim')} AS cn, {NUMBERS.format('claim')} AS x, {TYPE} AS type FROM sc),
  bs AS (SELECT item_id, regexp_extract_all(text, '([^.!?]*[.!?]+|[^.!?]+$)', 1) AS s FROM benchmark), bk AS (SELECT item_id, list_filter(list_transform(s, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 10) AS k FROM bs),
  so AS (SELECT item_id, item_id || '-' || place AS source_id, sentence, {STRIP.format('sentence')} AS st, {NEGATED.format('sentence')} AS sn, {NUMBERS.format('sentence')} AS y FROM (SELECT item_id, unnest(range(0, len(k))) AS place, unnest(k) AS sentence FROM bk)),
  m AS (SELECT *, len(list_intersect(ct, st)) AS shared FROM cl, so), fo AS (SELECT *, shared::DOUBLE / (len(ct) + len(st) - shared) AS relevance FROM m WHERE shared > 0 AND shared::DOUBLE / len(ct) >= 0.2),
  al AS (SELECT claim_id, item_id, source_id, sentence, claim, x, y, cn, sn, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY relevance DESC, source_id) AS INT) AS place, relevance, cn <> sn OR {DISAGREE} AS against FROM fo WHERE relevance >= 0.3),
  su AS (SELECT * FROM al WHERE place <= 5)"""
VERDICTS = SUPPORTS + """, o AS (SELECT claim_id, max(relevance) AS top, bool_or(against) AS against, count(*) AS n FROM su GROUP BY claim_id),
  ve AS (SELECT cl.claim_id, cl.claim, cl.type AS of, CASE WHEN top IS NULL THEN 'not_supported' WHEN against THEN 'contradicted' WHEN top >= 0.7 THEN 'supported' WHEN top >= 0.3 THEN 'partially_supported' ELSE 'unverifiable' END AS verdict,
    round(CASE WHEN top IS NULL THEN 0.7 WHEN against THEN 0.8 WHEN top >= 0.7 THEN least(0.95, top) WHEN top >= 0.3 THEN top ELSE 0.5 END, 6) AS confidence, coalesce(n, 0) AS passages FROM cl LEFT JOIN o USING (claim_id))"""
HALLUCINATED = VERDICTS + """, ha AS (SELECT claim_id, CASE WHEN of IN ('numerical', 'temporal') OR of = 'factual' AND confidence < 0.3 THEN 'fabrication' ELSE 'unsupported_inference' END AS type,
    CASE WHEN of = 'factual' AND confidence < 0.3 THEN 'critical' WHEN of IN ('numerical', 'temporal', 'causal', 'factual') THEN 'major' ELSE 'minor' END AS severity, round(1 - confidence, 6) AS confidence FROM ve WHERE verdict IN ('not_supported', 'unverifiable'))"""


def capitals(spark, sf):
    """Turns with two capitalised words before them: every other pair is in the sources."""
    t = table(spark, sf, "conversations")
    word = F.initcap(F.element_at(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), 1))
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("Old "), F.coalesce(word, F.lit("Nobody")), F.lit(" said: "), "text").alias("text"))


@query("TXT23_hallucination_types", HALLUCINATED + " SELECT * FROM ha")
def txt23b(spark, sf):
    c = numbered(spark, sf)
    return verification.claim_hallucinations(c, verification.verdicts(c, verification.supports(c, source_sentences(spark, sf))))


@query(
    "TXT23_fabricated_entities",
    """WITH t AS (SELECT conv_id || '-' || turn AS id, regexp_extract(lower(text), '([a-z]+)', 1) AS w, text FROM conversations), n AS (SELECT id, 'Old ' || CASE WHEN w = '' THEN 'Nobody' ELSE upper(w[1]) || w[2:] END || ' said: ' || text AS text FROM t),
    e AS (SELECT id, list_slice(regexp_extract_all(text, '([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)', 1), 1, 10) AS l FROM n), x AS (SELECT id, CAST(unnest(range(0, len(l))) AS INT) AS place, unnest(l) AS entity FROM e), all_text AS (SELECT string_agg(lower(text), chr(1)) AS s FROM benchmark)
    SELECT id, place, entity, 'fabrication' AS type, 'major' AS severity, 0.7::DOUBLE AS confidence FROM x, all_text WHERE NOT contains(s, lower(entity))""",
)
def txt23c(spark, sf):
    return verification.fabricated_entities(capitals(spark, sf), references(spark, sf))


@query(
    "TXT23_contradiction_kinds",
    VERDICTS + f""", kc AS (SELECT ve.claim_id, source_id, confidence, of, CASE WHEN {DISAGREE} THEN 'numerical' WHEN cn <> sn THEN 'direct' WHEN regexp_matches(su.claim, '{verification.TIMES}') AND regexp_matches(sentence, '{verification.TIMES}') THEN 'temporal' ELSE 'implicit' END AS type
      FROM ve JOIN su USING (claim_id) WHERE verdict = 'contradicted' AND place = 1)
    SELECT claim_id, source_id, type, CASE WHEN of IN ('factual', 'numerical') THEN 'critical' WHEN of IN ('temporal', 'causal') THEN 'major' ELSE 'minor' END AS severity, confidence FROM kc""",
)
def txt23d(spark, sf):
    c, s = numbered(spark, sf), source_sentences(spark, sf)
    found = checkpoint(verification.supports(c, s))  # it is read more than once
    return verification.contradictions(c, verification.verdicts(c, found), found, s)


@query("JN6_claims_and_sentences", SUPPORTS + " SELECT claim_id, source_id, place, round(relevance, 9) AS relevance, against FROM al")
def jn6(spark, sf):
    return verification.supports(numbered(spark, sf), source_sentences(spark, sf), keep=None).withColumn("relevance", F.round("relevance", 9))


@query("WIN19_evidence_top5", SUPPORTS + " SELECT claim_id, source_id, place, round(relevance, 9) AS relevance, against FROM su")
def win19(spark, sf):
    return verification.supports(numbered(spark, sf), source_sentences(spark, sf)).withColumn("relevance", F.round("relevance", 9))


@query("TXT22_verdicts", VERDICTS + " SELECT claim_id, verdict, confidence, passages FROM ve")
def txt22(spark, sf):
    c = numbered(spark, sf)
    return verification.verdicts(c, verification.supports(c, source_sentences(spark, sf)))


@query(
    "AGG16_faithfulness",
    HALLUCINATED
    + """, f AS (SELECT count(*) AS claims, count(*) FILTER (verdict IN ('supported', 'partially_supported')) / count(*)::DOUBLE AS support, (SELECT count(*) FROM ha) / count(*)::DOUBLE AS hallucination, count(*) FILTER (verdict = 'contradicted') / count(*)::DOUBLE AS contradiction,
      (SELECT count(DISTINCT item_id) FROM su) / (SELECT count(DISTINCT item_id) FROM so)::DOUBLE AS coverage FROM ve)
    SELECT claims, round(support, 6) AS support, round(hallucination, 6) AS hallucination, round(contradiction, 6) AS contradiction, round(coverage, 6) AS coverage, round(0.4 * support + 0.3 * (1 - hallucination) + 0.2 * (1 - contradiction) + 0.1 * coverage, 6) AS faithfulness FROM f""",
)
def agg16(spark, sf):
    c, s = numbered(spark, sf), source_sentences(spark, sf)
    found = checkpoint(verification.supports(c, s))  # it is read more than once
    judged = verification.verdicts(c, found)
    documents_of = s.withColumn("document_id", F.substring_index("source_id", "-", 1))
    return verification.faithfulness(judged, verification.claim_hallucinations(c, judged), found, documents_of)


def outputs_and_golden(spark, sf):
    """Golden samples are the turns; outputs repeat them, or say them otherwise, or answer the turn after."""
    t = table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    golden = t.select(F.col("id").alias("sample_id"), F.col("text").alias("golden"), F.lit(0).alias("ordinal"))
    said = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.col("text"), F.lit(" More words follow here."))).otherwise(F.reverse("text"))
    outputs = t.select(F.when(F.col("turn") == 7, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")).alias("sample_id"), said.alias("output"))
    return outputs, golden


GOLDEN = "WITH g AS (SELECT conv_id || '-' || turn AS sample_id, text AS golden, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || ' More words follow here.' ELSE reverse(text) END AS output FROM conversations WHERE turn <> 7)"


@query("JN1_golden_join", GOLDEN + " SELECT sample_id, md5(output) AS output_hash, md5(golden) AS golden_hash FROM g")
def jn1(spark, sf):
    o, g = outputs_and_golden(spark, sf)
    return verification.golden(o, g).select("sample_id", F.md5("output").alias("output_hash"), F.md5("golden").alias("golden_hash"))


@query("JN1_sample_mismatch", "SELECT 'x' || conv_id || '-' || turn AS sample_id FROM conversations WHERE turn = 7")
def jn1b(spark, sf):
    o, g = outputs_and_golden(spark, sf)
    return verification.mismatches(o, g)


WEIGHTS = ((2, 0.2), (3, 0.3), (4, 0.3), (5, 0.2))
SOME = {n: f"len(x{n}) > 0 AND len(y{n}) > 0" for n, _ in WEIGHTS}
MATCHED = GOLDEN + (
    f""", nm AS (SELECT sample_id, output, golden, {NORM.replace('text', 'output')} AS o, {NORM.replace('text', 'golden')} AS g FROM g),
  gr AS (SELECT *, {", ".join(f"{char_grams_sql('o', n)} AS x{n}, {char_grams_sql('g', n)} AS y{n}" for n, _ in WEIGHTS)}, {KW.format('o')} AS ko, {KW.format('g')} AS kg FROM nm),
  tb AS (SELECT *, {" + ".join(f"CASE WHEN {SOME[n]} THEN {w}::DOUBLE * {jaccard_sql(f'x{n}', f'y{n}')} ELSE 0 END" for n, w in WEIGHTS)} AS top, {" + ".join(f"CASE WHEN {SOME[n]} THEN {w}::DOUBLE ELSE 0 END" for n, w in WEIGHTS)} AS bottom FROM gr),
  sm AS (SELECT sample_id, o = g AS exact, round(CASE WHEN o = g THEN 1.0 WHEN bottom > 0 THEN top / bottom ELSE 0.0 END, 6) AS semantic, round({jaccard_sql('ko', 'kg')}, 6) AS keyword, round(0.5 * {{ratio}} + 0.5 * {{paragraphs}}, 6) AS structural FROM tb),
  mt AS (SELECT *, CASE WHEN exact THEN 'exact_match' WHEN semantic >= 0.85 THEN 'semantic_match' WHEN structural >= 0.9 THEN 'structural_match' WHEN keyword >= 0.6 OR semantic >= 0.5 THEN 'partial_match' ELSE 'no_match' END AS match FROM sm),
  gm AS (SELECT *, CASE WHEN match IN ('exact_match', 'semantic_match', 'structural_match') THEN 'pass' WHEN match = 'partial_match' THEN 'warning' WHEN semantic < 0.2 THEN 'critical' ELSE 'fail' END AS severity,
    round(CASE WHEN exact THEN 0.99 ELSE least(1.0, CASE WHEN semantic >= 0.95 THEN 0.95 WHEN semantic >= 0.85 THEN 0.75 + (semantic - 0.85) * 0.5 WHEN semantic >= 0.5 THEN 0.5 + semantic * 0.3 ELSE 0.4 + semantic * 0.2 END + CASE WHEN match = 'no_match' THEN 0.1 ELSE 0 END) END, 6) AS confidence FROM mt)"""
    .replace("{ratio}", "CASE WHEN greatest(length(output), length(golden)) = 0 THEN 1.0 ELSE least(length(output), length(golden)) / greatest(length(output), length(golden))::DOUBLE END")
    .replace("{paragraphs}", "CASE WHEN greatest({0}, {1}) = 0 THEN 1.0 ELSE least({0}, {1}) / greatest({0}, {1})::DOUBLE END".format(*(f"len(list_filter(regexp_split_to_array({c}, '\\n\\n+'), lambda x: trim(x) <> ''))" for c in ("output", "golden"))))
)


@query("TXT26_golden_match", MATCHED + " SELECT * FROM gm")
def txt26(spark, sf):
    o, g = outputs_and_golden(spark, sf)
    return verification.golden_match(verification.golden(o, g))


@query(
    "AGG13_golden_stats",
    MATCHED
    + ", ct AS (SELECT count(*) AS samples, "
    + ", ".join(f"count(*) FILTER (match = '{m}') AS {m}" for m in ("exact_match", "semantic_match", "structural_match", "partial_match", "no_match"))
    + ", " + ", ".join(f"count(*) FILTER (severity = '{v}') AS severity_{v}" for v in ("pass", "warning", "fail", "critical"))
    + """, CAST(floor(100 * (0.4 * (count(*) FILTER (severity = 'pass') / count(*)::DOUBLE) + 0.3 * (count(*) FILTER (exact) / count(*)::DOUBLE) + 0.2 * avg(semantic) + 0.1 * avg(confidence)) + 0.5) AS BIGINT) AS score FROM gm)
    SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM ct""",
)
def agg13(spark, sf):
    o, g = outputs_and_golden(spark, sf)
    return verification.golden_stats(verification.golden_match(verification.golden(o, g)))


WSET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@query("SET4_word_changes", GOLDEN + f", w AS (SELECT sample_id, {WSET.format('output')} AS o, {WSET.format('golden')} AS g FROM g) SELECT sample_id, CAST(len(o) - len(list_intersect(o, g)) AS INT) AS added, CAST(len(g) - len(list_intersect(o, g)) AS INT) AS removed FROM w")
def set4(spark, sf):
    o, g = outputs_and_golden(spark, sf)
    return verification.word_changes(verification.golden(o, g))


WANTED = {"exact": ("exact_match", None), "part": ("contains", None), "pattern": ("regex_match", "tion"), "length": ("length_ratio", None), "words": ("keyword_presence", ("the", "de", "tion")), "format": ("format_compliance", "code")}
SCORES = GOLDEN + """, s AS (SELECT sample_id, CAST(output = golden AS DOUBLE) AS exact, CAST(contains(output, golden) AS DOUBLE) AS part, CAST(regexp_matches(output, '(?i)tion') AS DOUBLE) AS pattern,
  CASE WHEN length(golden) = 0 THEN 0.0 ELSE greatest(0.0, 1 - abs(1 - length(output) / length(golden)::DOUBLE)) END AS length,
  (CAST(contains(lower(output), 'the') AS DOUBLE) + CAST(contains(lower(output), 'de') AS DOUBLE) + CAST(contains(lower(output), 'tion') AS DOUBLE)) / 3 AS words,
  CAST(regexp_matches(output, 'function|const|let|var|class|def |import |from ') AS DOUBLE) AS format FROM g)"""


def scores(spark, sf):
    o, g = outputs_and_golden(spark, sf)
    return verification.evaluate(verification.golden(o, g).select("sample_id", F.col("output").alias("content"), F.col("golden").alias("expected")), WANTED).drop("content", "expected")


@query("TXT16_scorers", SCORES + " SELECT sample_id, exact, part, pattern, round(length, 6) AS length, round(words, 6) AS words, format FROM s")
def txt16(spark, sf):
    return scores(spark, sf).withColumns({"length": F.round("length", 6), "words": F.round("words", 6)})


@query(
    "TXT17_composites",
    SCORES
    + """ SELECT sample_id, round(exact * 0.5 + length * 0.25 + words * 0.25, 6) AS weighted,
      round(CASE WHEN CAST(exact > 0 AS INT) + CAST(length > 0 AS INT) + CAST(words > 0 AS INT) = 0 THEN 0.0 ELSE (CASE WHEN exact > 0 THEN 0.5 ELSE 0 END + CASE WHEN length > 0 THEN 0.25 ELSE 0 END + CASE WHEN words > 0 THEN 0.25 ELSE 0 END)
        / (CASE WHEN exact > 0 THEN 0.5 / exact ELSE 0 END + CASE WHEN length > 0 THEN 0.25 / length ELSE 0 END + CASE WHEN words > 0 THEN 0.25 / words ELSE 0 END) END, 6) AS harmonic,
      round(exp(ln(greatest(exact, 0.001)) * 0.5 + ln(greatest(length, 0.001)) * 0.25 + ln(greatest(words, 0.001)) * 0.25), 6) AS geometric FROM s""",
)
def txt17(spark, sf):
    names, weights = ["exact", "length", "words"], [2.0, 1.0, 1.0]
    return scores(spark, sf).select("sample_id", *[F.round(verification.composite(names, weights, how), 6).alias(how) for how in ("weighted", "harmonic", "geometric")])


@query("AGG11_quality_bands", SCORES + f" SELECT count(*) AS n, round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS sd, {bands_sql('length', consistency.QUALITY_BANDS, 'very_poor')} FROM s")
def agg11(spark, sf):
    return consistency.banded(scores(spark, sf), [], "length", consistency.QUALITY_BANDS, "very_poor")


# bias


def biased_texts(spark, sf):
    """Conversation turns with a biased phrase put to one in five of them."""
    k = F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(5))
    phrase = F.when(k == 0, " You people, said the chairman, are lame.").when(k == 1, " A swarm of those people. OK boomer.").otherwise("")
    return table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.col("text"), phrase).alias("text"))


def bias_sql() -> str:
    by_type: dict[str, list[tuple[str, float]]] = {}
    for kind, p, r in bias.patterns():
        by_type.setdefault(kind, []).append((p.replace("'", "''"), r))
    count = lambda p: f"len(regexp_extract_all(text, '(?i){p}'))"
    each = " UNION ALL ".join(
        f"SELECT id, '{kind}' AS bias_type, CAST({' + '.join(count(p) for p, _ in rows)} AS BIGINT) AS matches, {' + '.join(f'{count(p)} * {r}::DOUBLE' for p, r in rows)} AS w FROM t" for kind, rows in sorted(by_type.items())
    )
    return f"""WITH t AS (SELECT conv_id || '-' || turn AS id, text || CASE (conv_id * 8 + turn) % 5 WHEN 0 THEN ' You people, said the chairman, are lame.' WHEN 1 THEN ' A swarm of those people. OK boomer.' ELSE '' END AS text FROM conversations),
    u AS ({each}), f AS (SELECT id, bias_type, matches, round(w / matches, 6) AS relevance FROM u WHERE matches > 0),
    v AS (SELECT *, CASE WHEN relevance >= 0.9 THEN 'critical' WHEN relevance >= 0.75 THEN 'high' WHEN relevance >= 0.5 THEN 'medium' WHEN relevance >= 0.3 THEN 'low' ELSE 'negligible' END AS severity FROM f)"""


@query("TXT24_bias_patterns", bias_sql() + " SELECT id, bias_type, matches, relevance FROM f")
def txt24(spark, sf):
    return bias.detect(biased_texts(spark, sf))


@query("FLT8_severity_floor", bias_sql() + " SELECT id, bias_type, severity FROM v WHERE severity IN ('high', 'critical')")
def flt8(spark, sf):
    found = bias.detect(biased_texts(spark, sf)).withColumn("severity", bias.severity(F.col("relevance")))
    return bias.at_least(found, "high").select("id", "bias_type", "severity")


@query(
    "AGG15_bias_assessment",
    bias_sql()
    + ", a AS (SELECT count(DISTINCT id) AS biased, CAST(coalesce(sum(matches), 0) AS BIGINT) AS matches, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in bias.SEVERITIES)
    + " FROM v), n AS (SELECT count(*) AS texts FROM t) SELECT texts, biased, matches, " + ", ".join(bias.SEVERITIES)
    + ", round(biased / texts::DOUBLE, 6) AS rate, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 OR biased / texts::DOUBLE >= 0.5 THEN 'high' WHEN medium > 0 OR biased / texts::DOUBLE >= 0.2 THEN 'medium' ELSE 'low' END AS assessment FROM a, n",
)
def agg15(spark, sf):
    texts = biased_texts(spark, sf)
    return bias.assessment(bias.detect(texts), texts)


@query("TXT24_neutral_terms", bias_sql() + " SELECT id, md5(regexp_replace(text, '(?i)\\bchairman\\b', 'chairperson', 'g')) AS hash FROM t")
def txt24b(spark, sf):
    return biased_texts(spark, sf).select("id", F.md5(bias.neutral(F.col("text"))).alias("hash"))


@query(
    "TXT12_judge_json",
    """WITH j AS (SELECT event_id, (event_id % 120) / 100.0 AS s, event_id % 7 AS k FROM events)
    SELECT event_id, CASE WHEN k = 5 THEN 'no JSON' WHEN k = 4 THEN 'no score' WHEN k = 3 THEN 'no reasoning' WHEN s > 1 THEN 'score out of range' END AS problem,
      CASE WHEN k NOT IN (3, 4, 5) AND s <= 1 THEN s END AS score, CASE WHEN k NOT IN (3, 4, 5) AND s <= 1 THEN 'because ' || event_id END AS reasoning,
      CASE WHEN k NOT IN (3, 4, 5) AND s <= 1 THEN CASE WHEN k IN (0, 6) THEN round(s / 2, 3) ELSE 1.0 END END::DOUBLE AS confidence FROM j""",
)
def txt12(spark, sf):
    """Judges' answers: with words around the JSON or none, without a confidence or with one that is no number, without a score or
    reasoning, without JSON."""
    k, score, why = F.col("event_id") % 7, (F.col("event_id") % 120 / 100.0).cast("string"), F.concat(F.lit('"reasoning": "because '), "event_id", F.lit('"'))
    sure = F.format_string('"confidence": %.3f', F.round(F.col("event_id") % 120 / 100.0 / 2, 3))
    full = F.concat(F.lit('{"score": '), score, F.lit(", "), why)
    said = (
        F.when(k == 0, F.concat(F.lit("Verdict: "), full, F.lit(", "), sure, F.lit("} thanks"))).when(k == 1, F.concat(full, F.lit("}"))).when(k == 2, F.concat(full, F.lit(', "confidence": "high"}')))
        .when(k == 3, F.concat(F.lit('{"score": '), score, F.lit("}"))).when(k == 4, F.concat(F.lit('{"score": "good", '), why, F.lit("}"))).when(k == 5, "I would rather not say")
        .otherwise(F.concat(F.lit("  "), full, F.lit(", "), sure, F.lit(', "more": {"a": [1, 2]}}\n')))
    )
    return verification.judged_answers(table(spark, sf, "events").select("event_id", said.alias("answer")), "answer").drop("answer")


@query(
    "TXT11_perplexity",
    """WITH e AS (SELECT vec_id, exp(-list_avg(list_transform(embedding::DOUBLE[], lambda x: -abs(x) * 10))) AS ppl FROM embeddings)
    SELECT vec_id, round(ppl, 6) AS perplexity, round(greatest(0.0, least(1.0, 1 / (1 + log10(ppl)))), 6) AS score, CASE WHEN ppl < 20 THEN 'excellent' WHEN ppl < 50 THEN 'good' WHEN ppl < 100 THEN 'fair' WHEN ppl < 200 THEN 'poor' ELSE 'very_poor' END AS band FROM e""",
)
def txt11(spark, sf):
    """From given log-probabilities (here: of each vector's entries)."""
    logs = F.transform("embedding", lambda x: -F.abs(x.cast("double")) * 10)
    ppl = F.exp(-F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(logs))
    e = table(spark, sf, "embeddings").select("vec_id", ppl.alias("p"))
    p = F.col("p")
    band = F.when(p < 20, "excellent").when(p < 50, "good").when(p < 100, "fair").when(p < 200, "poor").otherwise("very_poor")
    return e.select("vec_id", F.round(p, 6).alias("perplexity"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.log10(p)))), 6).alias("score"), band.alias("band"))
