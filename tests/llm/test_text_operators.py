import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdigris.llm import bm25, bpe, decontaminate, html_text, licenses, shards, simhash, url_filter

ODD = [None, "", " ", "a", "a b", "A  B\tc\x0bd", "\x1fa\x1f b", "éÉ ünï 日本 🎉", "x" * 5000, "w " * 3000]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, row int")


def random_texts(n, seed, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(words))) for _ in range(n)]


# op4


def brute_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def near_copies():
    base = random_texts(8, 1, 400)
    out = []
    for k, t in enumerate(base):
        w = t.split() * 3
        for c in range(6):
            out.append(" ".join(w[:-1] + [f"z{c}"]) if c else " ".join(w))
    return out


def test_fingerprints(spark):
    rows = list(enumerate(ODD + random_texts(40, 2)))
    got = simhash.near_duplicates(texts(spark, rows)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{brute_fingerprint(t):016x}" for i, t in rows}


def test_components_are_those_of_brute_force(spark):
    rows = [(i if i % 13 else None, t) for i, t in enumerate(ODD + near_copies() + near_copies()[:9] + random_texts(60, 3))]
    rows.append(rows[-1])  # a repeated row
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(texts(spark, rows)).collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    assert got == Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_components([i for i, _ in rows], prints)))


@pytest.mark.parametrize("large", [4096, 3])
def test_index_links_what_brute_force_links(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_BLOCK", large)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = list({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for b in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    expected = brute_components(signed, prints)
    assert [found.get(p, p) for p in signed] == expected


def test_blocks_go_on_over_batches(monkeypatch):
    """Edges are the same however the sorted rows fall into batches, and however few are indexed at a time."""
    import pyarrow as pa

    rng = random.Random(8)
    rows = []
    for block in range(7):
        base = rng.getrandbits(63)
        codes = sorted({base ^ sum({1 << rng.randrange(40) for _ in range(rng.randrange(3))}) for _ in range(rng.choice([1, 5, 90]))}, key=lambda c: simhash_rank(c))
        rows += [(block, c) for c in codes]
    whole = pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in rows], pa.int64()), "fp": pa.array([c for _, c in rows], pa.int64())})
    edges = lambda size: sorted((e["a"], e["b"]) for part in simhash.linked(iter([whole.slice(k, size) for k in range(0, len(whole), size)])) for e in part.to_pylist())
    expected = edges(len(whole))
    for at_once in (1, 10, 1 << 17):
        monkeypatch.setattr(simhash, "INDEXED_AT_ONCE", at_once)
        assert all(edges(size) == expected for size in (1, 7, 40, len(whole)))


def simhash_rank(code):
    for shift in (32, 16, 8, 4, 2, 1):
        code ^= code >> shift
    return code


def test_dense_groups_close_without_all_pairs():
    codes = np.sort(np.array([(1 << a | 1 << b) for a in range(40) for b in range(a)], np.uint64))
    assert (simhash.links_within(codes, np.array([0])) == 0).all()


def test_one_of_each_group_stays(spark):
    rows = [(3, "one two three four"), (1, "one two three four"), (1, "one two three four"), (None, "one two three four"), (7, "alone in the world now"), (None, "nobody knows this text here")]
    docs = texts(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", rows[1][1]), ("7", rows[4][1]), ("None", rows[5][1])]
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_one_of_each_group_stays_by_ids_of_any_type(spark):
    rows = [("b", "one two three four"), ("a10", "one two three four"), ("a2", "one two three four"), (None, "one two three four"), ("", "alone in the world now"), (None, "nobody knows this text here")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id string, text string, row int, key string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema["doc_id"].dataType.simpleString() == "string"
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("", rows[4][1]), ("None", rows[5][1]), ("a10", rows[1][1])]


# op5


def brute_decontamination(text, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    w, hit, names = word.findall(lower(text)), set(), set()
    for item, t in items:
        b = word.findall(lower(t))
        n = min(10, len(b))
        for window in {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    names.add(str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    items = [(1, " ".join(f"k{i}" for i in range(14))), (2, "Short One"), (10, "short one"), (3, ""), (4, None), (5, "Ä b c d e f g h i j k")]
    filler = random_texts(20, 7)
    docs = [*ODD, *filler, "pre " + items[0][1].upper() + " post", items[0][1] + " " + items[0][1], "a short, ONE! and short-one", "ä b c d e f g h i j", "Ä b c d e f g h i j", " ".join(f"k{i}" for i in range(9))]
    rows = list(enumerate(docs)) + [(0, docs[-4]), (None, docs[-4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate.report(texts(spark, rows), bench).collect())
    assert got == Counter((i, *brute_decontamination(t, items)) for i, t in rows)
    kept = decontaminate.drop_contaminated(texts(spark, rows), bench)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(i) for i, t in rows if not brute_decontamination(t, items)[-1])
    assert decontaminate.report(texts(spark, rows), bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.report(texts(spark, rows[:0]), bench).count() == 0


@pytest.mark.parametrize("name,bound", [("MOST_BROADCAST", 0), ("MOST_PLACES", 8), ("MOST_KEYS", 0)])
def test_decontamination_beyond_its_bounds(spark, monkeypatch, name, bound):
    """What is too large to broadcast is shuffled, and a full table only lets more through: same results."""
    items = [(k, " ".join(f"k{i * k}" for i in range(14))) for k in range(1, 40)]
    rows = list(enumerate(random_texts(30, 8))) + [(100 + k, f"a {t} b") for k, t in items[::3]] + [(None, None), (7, "12")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, name, bound)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate.report(texts(spark, rows), bench).collect())
    assert got == Counter((i, *brute_decontamination(t, items)) for i, t in rows)
    kept = decontaminate.drop_contaminated(texts(spark, rows), bench)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(i) for i, t in rows if not brute_decontamination(t, items)[-1])


# op6


def test_codec_is_the_librarys():
    source = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    codec, library = bpe.Codec(source, kept=2000), Tokenizer.from_str(source)
    rng = random.Random(1)
    odd = ["".join(rng.choice("abc dE'stre  \n\x1c\x85\u200b\u3000²½٣一éÉ_-=!|") for _ in range(60)) for _ in range(500)]
    for t in [*filter(None, ODD), "a<|endoftext|>b <|endoftext|>", "don't we'll  x\n\n y\t", "=" * 3000, *odd, *random_texts(50, 4)]:
        ids, expected = codec.encode(t), library.encode(t, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids, t[:80]
        assert codec.decode(ids) == library.decode(expected.ids, skip_special_tokens=False)


def test_encoded_table(spark):
    rows = list(enumerate(ODD))
    got = {r["doc_id"]: r for r in bpe.encode(texts(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for i, t in rows:
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["n_tokens"] * 4 == len(got[i]["ids"])


def test_flags_that_are_not_made_are_refused():
    import json

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    for change in (lambda s: s["model"].update(ignore_merges=True), lambda s: s["added_tokens"][0].update(lstrip=True)):
        other = json.loads(json.dumps(spec))
        change(other)
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(other))


def test_encoding_of_repeated_rows_and_none(spark):
    path, rows = public_tokenizers.path("byte_bpe_50k.json"), [(1, "a b"), (1, "a b"), (None, "a b")]
    got = bpe.encode(texts(spark, rows), path).collect()
    assert len(got) == 3 and len({r["ids_sha256"] for r in got}) == 1
    assert bpe.encode(texts(spark, rows[:0]), path).count() == 0


# op7


def test_rules_and_parts(spark):
    urls = [None, "", "nothing", "http://Sub.Example.ORG/en/12?x#y", "https://a.org", "x://a.com/fr/", "x://a.com/de/1", "x://acom/de/", "x://example.org/es/q", "x://H?y", "x://h/p#z?y", "a://b://c"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame([], "host string, bad int")).collect()}
    get = lambda i: tuple(found[i][c] for c in ("host", "path", "rule", "verdict"))
    assert get(0) == get(1) == get(2) == ("", "", None, "allow")
    assert get(3) == ("sub.example.org", "/en/12", "example.org/en/1", "block") and get(4) == ("a.org", "", None, "allow")
    assert get(5)[2:] == ("com/fr/", "allow") and get(6)[2:] == ("com/de/", "block") and get(7)[2:] == (None, "allow") and get(8)[2:] == ("example.org/es/", "block")
    assert get(9)[:2] == ("h", "") and get(10)[:2] == ("h", "/p") and get(11)[:2] == ("b:", "//c")


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.x.net", 1)] * 60 + [(f"h{i}.y.net", int(i % 10 == 0)) for i in range(200)] + [("once.y.net", 1)]
    r = {x["host"]: x for x in url_filter.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert r["bad.x.net"]["lower"] > 0.5 and r["once.y.net"]["rate"] < 0.5


def test_hosts_without_outcomes_have_the_rate_above_them(spark):
    """A new host is blocked where its domain is bad, and where only its suffix is; elsewhere it isn't."""
    rows = [(f"h{i}.bad.net", int(i % 10 > 0)) for i in range(20) for _ in range(20)] + [(f"g{i}.good.com", int(i % 10 == 0)) for i in range(20) for _ in range(20)]
    hosts = ["new.bad.net", "new.other.net", "new.good.com", "new.other.com", "h1.bad.net", "h0.bad.net", "g1.good.com"]
    pages = spark.createDataFrame([(i, f"x://{h}/p") for i, h in enumerate(hosts)] + [(9, None)], "page_id long, url string")
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    verdict = {r["host"]: r["verdict"] for r in url_filter.judge(pages, outcomes).collect()}
    assert verdict["new.bad.net"] == verdict["h1.bad.net"] == "block" and verdict["new.good.com"] == verdict["g1.good.com"] == verdict["h0.bad.net"] == "allow"
    known, r = ({x["host"]: x for x in url_filter.reputations(outcomes, *s).collect()} for s in ((), (pages.select(url_filter.host_of(F.col("url")).alias("host")),)))
    assert all(abs(r[h]["rate"] - known[h]["rate"]) < 1e-9 for h in known)  # the strengths are those of hosts with outcomes
    assert r["new.bad.net"]["rate"] > 0.8 and r["new.other.net"]["rate"] > r[""]["rate"] > r["new.other.com"]["rate"]
    assert verdict == {h: "block" if r[h]["lower"] > url_filter.MOST_BAD else "allow" for h in verdict}


def test_urls_that_repeat_and_none(spark):
    pages = spark.createDataFrame([(1, "x://a.b/c")] * 3, "page_id long, url string")
    outcomes = spark.createDataFrame([], "host string, bad int")
    assert url_filter.judge(pages, outcomes).count() == 3 and url_filter.judge(pages.where("false"), outcomes).count() == 0


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "u:p@x.Y.com:8080": ("Y.com", "com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "com": ("com", "com"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_filter.domain_of(F.col("host")).alias("d"), url_filter.suffix_of(F.col("host")).alias("s"))
    assert {r["host"]: (r["d"], r["s"]) for r in rows.collect()} == hosts


# op3


def test_licenses_against_all_shingles(spark):
    notice = licenses.TEMPLATES["MIT grant"]
    docs = [*ODD, *random_texts(20, 9), "x y " + notice.upper() + " z", " ".join(notice.split()[:-3]), " ".join(notice.split()[:8]), " ".join(licenses.TEMPLATES.values()), licenses.TEMPLATES["MIT"] + " foo " * 50 + licenses.TEMPLATES["MIT"]]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(texts(spark, list(enumerate(docs)))).collect()}
    expected = set()
    for i, t in enumerate(docs):
        have = licenses.shingles(licenses.words(t))
        for name, template in licenses.TEMPLATES.items():
            want = licenses.shingles(licenses.words(template))
            if len(want & have) / len(want) >= licenses.LEAST:
                expected.add((i, name))
    assert set(got) == expected
    assert got[len(docs) - 1, "MIT"]["places"] == 2


def test_licenses_do_not_depend_on_batches():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    cut = [" ".join(licenses.TEMPLATES[n].split()[:-3]) for n in ("MIT grant", "GPL-2.0 or later notice")]
    docs = [licenses.words(t) for t in [cut[0], "a b", *random_texts(12, 9), "x y " + cut[1], "", *licenses.TEMPLATES.values(), "z " * 7 + cut[0], cut[1], None]]
    alone = [[(d, *rest) for _, *rest in scanner.scan([t])] for d, t in enumerate(docs)]
    assert [x[1] for x in alone[0]] == ["MIT grant"] and alone[-2] and alone[-3] and not alone[1]
    for k in range(len(docs)):
        assert scanner.scan(docs[:k]) + [(d + k, *rest) for d, *rest in scanner.scan(docs[k:])] == [x for found in alone for x in found]
    assert scanner.scan([]) == []


def test_edited_licenses_at_the_bound_are_found():
    """Of notices edited down to a containment of 0.8 at least, none is missed, wherever they stand."""
    rng, filler = random.Random(21), random_texts(1, 22, 60)[0].split() * 3
    scanner, docs, expected = licenses.Scanner(licenses.TEMPLATES), [], set()
    names = [n for n in licenses.TEMPLATES if n.endswith(("notice", "grant"))]
    for k in range(1200):
        name = names[k % len(names)]
        w = licenses.words(licenses.TEMPLATES[name])
        want, edited = licenses.shingles(w), list(w)
        for _ in range(20):
            trial = list(edited)
            trial[rng.randrange(len(trial))] = "edit"
            if len(want & licenses.shingles(trial)) >= licenses.LEAST * len(want):
                edited = trial
        docs.append(filler[: rng.randrange(40)] + edited + filler[: rng.randrange(60)])
        expected.add((k, name))
    assert expected <= {x[:2] for x in scanner.scan(docs)}


def test_templates_of_few_words_are_looked_up():
    docs = [licenses.words(t) for t in ("The UNLICENSE, the unlicense", "un license", "", "public", "domain", "in the public domain: public domain public", "a b c d a b")]
    found = licenses.Scanner({"U": "Unlicense", "P": "public domain", "F": "a b c d", "none": "--"}).scan(docs)
    assert found == [(0, "U", 1.0, 1, 2), (5, "P", 1.0, 2, 2), (6, "F", 1.0, 0, 1)]


def test_licenses_of_repeated_rows_and_none(spark):
    notice = licenses.TEMPLATES["MIT"]
    assert licenses.scan(texts(spark, [(1, notice), (1, notice), (None, notice)])).count() == 3
    assert licenses.scan(texts(spark, [])).count() == 0 and licenses.scan(texts(spark, [(1, notice)]), {}).count() == 0


# op8


def test_top_k_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bm25, "DOCS_IN_SHARD", 200)
    monkeypatch.setattr(bm25, "TERMS_IN_QUERY_BLOCK", 300)
    rows = list(enumerate(random_texts(700, 11, 60) + ODD)) + [(None, "aa bb")]
    docs = texts(spark, rows)
    got = {}
    for r in bm25.top_k(docs, docs.where("doc_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    bags = [Counter(word.findall(lower(t))) for _, t in rows]
    df, avg = Counter(w for b in bags for w in b), sum(sum(b.values()) for b in bags) / len(bags)
    for (q, _), bag in zip(rows, bags):
        if q is None or q % 20 or not bag:
            continue
        scores = []
        for (d, _), b in zip(rows, bags):
            s = sum(n * np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / avg)) for w, n in bag.items() if w in b)
            if s:
                scores.append((-round(s, 9), d is None, d))
        best = sorted(scores)[:10]
        assert [(d, round(s, 6)) for _, d, s in sorted(got[q])] == [(d, round(-s, 6)) for s, _, d in best]


def test_equal_texts_score_equal_in_every_shard(spark, monkeypatch):
    """Copies lie in many shards, more of them than fit into the best: the smallest ids are found, by any cut into shards."""
    some = random_texts(40, 17, 80)
    rng = random.Random(5)
    rows = [(i, some[rng.randrange(40)]) for i in range(900)]
    rng.shuffle(rows)
    docs = texts(spark, rows).repartition(4)
    asked = docs.where("doc_id < 25")
    cuts = []
    for shard, common in ((37, 16), (300, 2), (4096, 16), (64, 900)):
        monkeypatch.setattr(bm25, "DOCS_IN_SHARD", shard)
        monkeypatch.setattr(bm25, "COMMON_SHARE", common)
        cuts.append(sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in bm25.top_k(docs, asked, 7).collect()))
    assert cuts[0] == cuts[1] == cuts[2] == cuts[3]
    text_of = dict(rows)
    for q in {c[0] for c in cuts[0]}:
        hits = [c for c in cuts[0] if c[0] == q]
        score_of = {}
        for _, _, d, score in hits:
            assert score_of.setdefault(text_of[d], score) == score
        same = sorted(d for d, t in rows if t == text_of[q])
        assert [d for _, _, d, _ in hits][: len(same)] == same[:7]


def test_repeated_queries_are_one_and_texts_of_one_id_are_ranked_apart(spark):
    docs = texts(spark, list(enumerate(random_texts(60, 31))))
    one, other = docs.where("doc_id = 3"), docs.where("doc_id = 4").withColumn("doc_id", F.lit(3).cast("long"))
    ranked = lambda queries: sorted(((r["rank"], r["doc_id"], round(r["score"], 9)) for r in bm25.top_k(docs, queries).collect()), key=str)
    first, second = ranked(one), ranked(other)
    assert len(first) == len(second) == 10 and first != second
    assert ranked(one.union(one)) == first
    assert ranked(one.union(other).union(one)) == sorted(first + second, key=str)


def test_queries_without_id_strings_and_empty_tables(spark):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(random_texts(50, 41))] + [(None, "aa bb cc aa")], "doc_id string, text string")
    found = bm25.top_k(docs, docs.where("doc_id IS NULL OR doc_id = 'd7'"), 3).collect()
    assert {r["query_id"] for r in found} <= {None, "d7"} and [r["doc_id"] for r in found if r["query_id"] is None and r["rank"] == 1] == [None]
    assert bm25.top_k(docs, docs.where("false")).count() == 0 and bm25.top_k(docs.where("false"), docs).count() == 0


def test_common_terms_are_pruned_without_loss(monkeypatch):
    """A shard's results are those of scoring everything, whatever counts as common and however large blocks are."""
    rng = np.random.default_rng(3)
    docs = [np.unique(rng.zipf(1.3, rng.integers(5, 120)) % 400, return_counts=True) for _ in range(700)]
    lists = {c: np.frombuffer(raw, bm25.LISTS[c]) for c, raw in bm25.invert([t for t, _ in docs], [c for _, c in docs]).items()}
    average = float(np.mean([c.sum() for _, c in docs]))
    weight = rng.random(400) + 0.1
    asked = docs[::35]
    terms, sizes = np.concatenate([t for t, _ in asked]), np.array([len(t) for t, _ in asked])
    packed = bm25.Queries.pack(np.arange(len(asked)), sizes, terms, weight[terms])
    for share, most, block in ((16, 1024, 4), (2, 1024, 64), (700, 20, 1), (1, 1, 7)):
        for name, value in (("COMMON_SHARE", share), ("MOST_COMMON", most), ("BLOCK", block), ("QUERIES_AT_ONCE", 7)):
            monkeypatch.setattr(bm25, name, value)
        found = {q: (d.tolist(), s) for q, d, s in bm25.Shard.load(lists, average).search(packed, np.zeros(len(asked)), 10)}
        for q, (t, _) in enumerate(asked):
            scores = np.array([sum(weight[x] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * c.sum() / average)) for x, n in zip(d, c) if x in set(t)) for d, c in docs])
            best = np.lexsort((np.arange(700), -scores.round(9)))[:10]
            assert np.allclose(found[q][1], scores[best]) and found[q][0] == best.tolist()


def test_near_ties_are_ranked_exactly_though_pruned_in_single_precision():
    """Scores that single precision cannot tell apart; what is added up for all documents is in it, what reaches a threshold is scored from its own terms."""
    n = 300
    docs = [(np.arange(12), np.where(np.arange(12) == i % 12, 1 + i % 5, 1)) for i in range(n)]
    lists = {c: np.frombuffer(raw, bm25.LISTS[c]) for c, raw in bm25.invert([t for t, _ in docs], [c for _, c in docs]).items()}
    weight = 1 + np.arange(12) * 1e-9
    packed = bm25.Queries.pack(np.arange(1), np.array([12]), np.arange(12), weight)
    shard = bm25.Shard.load(lists, 13.0)
    assert shard.common.dtype == shard.gain.dtype == np.float32
    ((_, found, scores),) = shard.search(packed, np.zeros(1), 10)
    full = np.array([sum(weight * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * c.sum() / 13.0))) for _, c in docs])
    best = np.lexsort((np.arange(n), -full.round(13)))[:10]
    assert found.tolist() == best.tolist() and np.allclose(scores, full[best], rtol=1e-14)
    floor = np.array([scores[4]])  # a threshold that is met exactly
    ((_, again, _),) = shard.search(packed, floor, 10)
    assert again[:5].tolist() == found[:5].tolist()


def test_queries_of_one_language_lie_together_and_blocks_overlap(spark, monkeypatch):
    rng = np.random.default_rng(8)
    language = rng.integers(0, 2, 60)
    terms = [np.unique(np.append(g * 1000, rng.zipf(1.4, 40) % 300 + g * 1000)) for g in language]
    laid = language[bm25.alike(np.array([len(t) for t in terms]), np.concatenate(terms))]
    assert (np.diff(laid) != 0).sum() == 1
    monkeypatch.setattr(bm25, "TERMS_IN_QUERY_BLOCK", 100)
    monkeypatch.setattr(bm25, "DOCS_IN_SHARD", 20)
    running, most, plain = [], [], bm25.search_block

    def watched(*args):
        running.append(1)
        most.append(len(running))
        plain(*args)
        running.pop()

    monkeypatch.setattr(bm25, "search_block", watched)
    some = random_texts(60, 31)
    docs = texts(spark, list(enumerate(some)))
    found = {r["query_id"] for r in bm25.top_k(docs, docs.where("doc_id < 12")).collect()}
    assert found == {i for i in range(12) if re.search("[^\x00-\x2f\x3a-\x60\x7b-\x7f]", some[i])}
    assert len(most) > 2 and max(most) == 2


# op9


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1003])
def test_shards_have_exact_sizes_and_gapless_slots(spark, n):
    docs = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 5 > 0, F.lit("é")).alias("text"))
    got = shards.shard_documents(docs).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == n and max(sizes.values(), default=0) - min((sizes[k] for k in range(8)), default=0) <= 1
    for s, k in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(k))
    assert {(r["size"], r["text_crc32"]) for r in got} <= {(1, 0), (3, zlib.crc32("é".encode()))}


def test_shards_keep_other_columns_and_refuse_their_own(spark):
    rows = spark.range(50).select("id", *[F.lit(k).alias(c) for k, c in enumerate(("_row", "_part", "_k", "_piece", "_in", "_a", "_b"))])
    got = shards.shuffle(rows).collect()
    assert sorted(r["id"] for r in got) == list(range(50)) and all((r["_row"], r["_part"], r["_k"], r["_piece"], r["_in"]) == (0, 1, 2, 3, 4) for r in got)
    with pytest.raises(ValueError):
        shards.shuffle(rows.withColumn("Slot", F.lit(1)))


def test_shuffles_are_uniform(spark):
    """Over many seeds each row comes to each shard, and to each half of it, about as often as to any other."""
    rows = spark.range(16)
    seen = np.zeros((16, 4, 2))
    for seed in range(60):
        for r in shards.shuffle(rows, 4, seed).collect():
            seen[r["id"], r["shard"], int(r["slot"] >= 2)] += 1
    assert (np.abs(seen.sum(axis=2) - 15) < 4.5 * np.sqrt(15 * 0.75)).all() and (np.abs(seen - 7.5) < 5 * np.sqrt(7.5)).all()


def test_matrix_and_draws():
    parts = [30, 0, 50, 21]
    m = shards.communication_matrix(parts, shards.equal_sizes(sum(parts), 8), 3)
    assert [sum(line) for line in m] == parts and [sum(c) for c in zip(*m)] == shards.equal_sizes(101, 8)
    rng = np.random.default_rng(1)
    draws = [shards.hypergeometric(rng, 3, 5, 2) for _ in range(20_000)]
    assert np.abs(np.bincount(draws, minlength=3) / 20_000 - np.array([10, 15, 3]) / 28).max() < 0.02
    assert abs(shards.hypergeometric(rng, 10**12, 3 * 10**12, 10**11) / 10**11 - 0.25) < 1e-4


# op10

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies &amp; more of them on this page.</div>
<article><h1>A  title</h1><p><b>First &lt;block&gt;<br><p>Second
 block &copy; with <a href="#">a link</a> in it, long enough to count as text.<aside>Aside text</aside><p>Third block, which is also of some length.
<div class="comments"><p>Reader comment that is rather long, and goes on and on.</div><form><input value="x">Subscribe</form></article>
<div id="sidebar"><p>Related</p></div><footer>Footer &middot; text</footer></body></html>"""


def test_article_of_a_page():
    assert html_text.main_text(PAGE) == "A title\nFirst <block>\nSecond block © with a link in it, long enough to count as text.\nThird block, which is also of some length."


def test_page_without_article_element():
    body = "<p>One paragraph with a good many words in it, as articles have.</p><p>And another one that is about as long as the first.</p>"
    page = f"<body><div><ul>{'<li><a href=x>link text</a>' * 20}</ul></div><div><div class='content'>{body}</div></div><div class='ad'>Buy</div></body>"
    assert html_text.main_text(page) == "One paragraph with a good many words in it, as articles have.\nAnd another one that is about as long as the first."


LONG = "<p>One paragraph with a good many words in it, as articles have.</p><p>And another one that is about as long as the first.</p>"
LONG_TEXT = "One paragraph with a good many words in it, as articles have.\nAnd another one that is about as long as the first."
SIDE = "<div class='sidebar'><p>Related things, to be read elsewhere</p></div>"


@pytest.mark.parametrize("wrapper", ["<div class='content has-sidebar'>", "<div class='no-sidebar'>", "<div id='right-sidebar'>", "<form id='aspnetForm'>", "<form><div class='searchPage'>"])
def test_wrappers_of_the_article_are_kept(wrapper):
    assert html_text.main_text(f"<body>{wrapper}<article>{LONG}</article>{SIDE}") == LONG_TEXT
    assert html_text.main_text(f"<body>{wrapper}<div>{LONG}</div>{SIDE}") == LONG_TEXT
    assert html_text.main_text(f"<body><main>{wrapper}<article>{LONG}<div class='comments'><article class='comment'><p>I say</article></div></article>") == LONG_TEXT


def test_text_beside_the_article_element():
    assert html_text.main_text(f"<body><main><article>{LONG}</article><article><h2>More</h2>{LONG}</article></main>{SIDE}") == f"{LONG_TEXT}\nMore\n{LONG_TEXT}"
    long, short = f"<article><div>{LONG * 3}</div></article>", f"<article><div>{LONG}</div></article>"
    assert html_text.main_text(f"<body><main>{long}{short}</main>{SIDE}") == "\n".join([LONG_TEXT] * 4)
    assert html_text.main_text(f"<body>{long}{short}{SIDE}") == "\n".join([LONG_TEXT] * 4)
    assert html_text.main_text(f"<body><div class='ad'>{LONG}</div><article><p>Short</p></article>") == "Short"
    assert html_text.main_text(f"<body><h1>Site</h1><main><div><h1>Title</h1></div><article>{LONG}</article></main>") == f"Title\n{LONG_TEXT}"
    assert html_text.main_text(f"<body><main><h1>Title</h1><div><article>{LONG}</article><article>{LONG}</article></div></main>") == f"Title\n{LONG_TEXT}\n{LONG_TEXT}"


def test_densities_choose_without_article_elements():
    """Pages of many shapes give one text, with the article element and with a plain div in its place."""
    rng = random.Random(13)
    for k in range(60):
        paragraphs = ["".join(f"<p>{t}.</p>" if rng.random() < 0.8 else f"<h2>{t}</h2>" for t in random_texts(rng.randrange(2, 9), 50 + k, 60) if t)] * rng.randrange(1, 3)
        links = "".join(f"<li><a href='/{i}'>go {i}</a></li>" for i in range(rng.randrange(3, 20)))
        page = f"<body><nav><ul>{links}</ul></nav><div class='wrap'><article><h1>A title of it</h1>{''.join(paragraphs)}</article></div><div><ul>{links}</ul></div><footer>Foot</footer></body>"
        assert html_text.main_text(page) == html_text.main_text(page.replace("article>", "div>")) != ""


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("   ", ""), ("<br>", ""), ("<!-- x", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("</p></div>x", "x"), ("<div>" * 3000 + "deep", "deep")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_pages_that_repeat_and_none(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a")] * 3, "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 3 and html_text.extract(pages.where("false")).count() == 0


def test_extracted_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[1]["n_chars"] == len(html_text.main_text(PAGE))
