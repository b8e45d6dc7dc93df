"""Edit distances of long texts, and evidence without pairs, against what is defined plainly."""

import re
import random
import time

import pytest
from pyspark.sql import functions as F

from verdigris.functions import edits
from verdigris.functions import similarity as S
from verdigris.operators import verification


def plain_edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, line = line, [i + 1]
        for j, y in enumerate(b):
            line.append(min(before[j] + (x != y), before[j + 1] + 1, line[j] + 1))
    return line[-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijkl", "aé🎉日b"])
def test_edits_are_what_the_table_says(letters):
    rng = random.Random(len(letters))
    for _ in range(300):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in "ab")
        assert edits.edits(a, b) == plain_edits(a, b) == edits.edits(list(b), list(a))
    assert edits.edits("", "") == 0 and edits.edits("x" * 500, "x" * 500) == 0


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [rng.choice(["new", "other", "word"])] * rng.randrange(2)
    return words


def test_long_texts_take_bounded_time(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    other = changed(rng, words, 400)
    a, b, c = " ".join(words), " ".join(other), " ".join(f"v{rng.randrange(3000)}" for _ in range(20_000))
    df = spark.createDataFrame([(1, a, b), (2, a, c), (3, "kitten", "sitting"), (4, "", "ab"), (5, None, "x"), (6, a, a), (7, "", "")], "i int, a string, b string").repartition(4)
    began = time.time()
    got = {r["i"]: r for r in S.with_word_error_rate(df, "a", "b", "w").select("i", "w", S.character_error_rate(F.col("a"), F.col("b")).alias("c"), S.levenshtein_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert time.time() - began < 120
    assert 0.9 < got[2]["w"] <= 1 and got[6]["w"] == got[6]["c"] == 0 and got[6]["s"] == 1
    assert abs(got[3]["s"] - (1 - 3 / 7)) < 1e-12 and got[4]["c"] == 1 and got[5]["s"] is None and got[7]["s"] == 1
    head = edits.edits(words[:1500], changed(random.Random(5), words[:1500], 60))
    assert head == plain_edits(words[:1500], changed(random.Random(5), words[:1500], 60))
    assert got[1]["w"] == edits.edits(words, other) / 20_000 <= 400 / 20_000


def test_long_is_as_short(spark, monkeypatch):
    rng = random.Random(9)
    pairs = [tuple("".join(rng.choice("abc é") for _ in range(rng.randrange(60))) for _ in "ab") for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    monkeypatch.setattr(edits, "LONG", 400)
    assert df.where(edits.edit_distance(F.col("a"), F.col("b")) != F.levenshtein("a", "b")).count() == 0
    assert df.where(F.char_length("a") * F.char_length("b") > 400).count() > 50


@pytest.mark.parametrize("block", [1 << 30, 60])
def test_support_is_what_all_pairs_say(spark, monkeypatch, block):
    rng = random.Random(4)
    some = "the river is not deep here and boats never pass under old bridges without a guide".split()
    text = lambda: " ".join(rng.choice(some) for _ in range(rng.randrange(12)))
    claims = spark.createDataFrame([(str(i % 50), text()) for i in range(60)] + [("e", ""), ("s", "zz"), (None, text())], "claim_id string, claim string")
    references = spark.createDataFrame([(i, text()) for i in range(25)] + [(30, ""), (31, "qq"), (3, text())], "reference_id int, reference string")
    monkeypatch.setattr(verification, "ELEMENTS_IN_BLOCK", block)
    got = {r["claim_id"]: r for r in verification.support(claims, references).collect()}
    want = verification.evidence(claims, references).groupBy("claim_id").agg(
        F.max("similarity").alias("support"), F.count_if("contradicts").alias("against"), F.avg(1 - F.col("coverage")).alias("unmatched"), F.count("*").alias("n"),
        F.avg("similarity").alias("mean"), F.var_pop("similarity").alias("variance"), F.min(F.struct((-F.round("similarity", 9)).alias("s"), "reference_id")).getField("reference_id").alias("best_reference"),
    )
    rows = want.collect()
    assert len(rows) == len(got)
    for r in rows:
        mine = got[r["claim_id"]]
        assert (mine["n"], mine["against"]) == (r["n"], r["against"])
        assert all(abs(mine[c] - r[c]) < 1e-9 for c in ("support", "unmatched", "mean", "variance"))
        assert r["support"] == 0 or mine["best_reference"] == r["best_reference"]
    assert verification.support(claims, references.limit(0)).count() == 0
    assert verification.support(claims.limit(0), references).count() == 0


def test_evidence_lists_every_pair_over_blocks(spark, monkeypatch):
    """Also pairs that share nothing and those of null texts, however the references are cut, against plain sets."""
    monkeypatch.setattr(verification, "ELEMENTS_IN_BLOCK", 40)
    monkeypatch.setattr(verification, "LINES_AT_ONCE", 7)
    mine = [("c1", "The river is wide"), ("c2", "The river is NOT wide, 日本語"), ("c3", ""), ("c4", None), ("c5", "ab")]
    theirs = [(1, "the river is wide"), (2, None), (3, "zz"), (4, "Nothing of the kind; the bridge"), (5, "no river")]
    got = verification.evidence(spark.createDataFrame(mine, "claim_id string, claim string"), spark.createDataFrame(theirs, "reference_id int, reference string"))
    words = lambda t: {w for w in re.split(r"[^a-z0-9_]+", (t or "").lower()) if len(w) > 2}
    grams = lambda t: {(t or "").lower()[i : i + 3] for i in range(len(t or "") - 2)}
    negative = lambda t: bool(re.search(verification.NEGATIONS, t.lower()))
    expected = {}
    for c, a in mine:
        for r, b in theirs:
            coverage = len(words(a) & words(b)) / len(words(a)) if words(a) else 0.0
            alike = len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(a) and grams(b) else 0.0
            expected[c, r] = (coverage, alike, coverage * 0.4 + alike * 0.6, alike > 0.3 and negative(a) != negative(b))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 25 and {r[:2] for r in rows} == expected.keys()
    assert all(r[2:5] == pytest.approx(expected[r[:2]][:3]) and r[5] == expected[r[:2]][3] for r in rows)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [1 << 30, 30])
def test_supports_are_what_all_pairs_say_without_a_nested_loop(spark, monkeypatch, block):
    """However the sources are cut, and over several tasks though the texts come in one."""
    monkeypatch.setattr(verification, "ELEMENTS_IN_BLOCK", block)
    monkeypatch.setattr(verification, "LINES_AT_ONCE", 5)
    rng = random.Random(8)
    some = "river deep here boats never pass under bridges without guide 7 9 not".split()
    text = lambda: " ".join(rng.choice(some) for _ in range(rng.randrange(9)))
    mine = [(f"c{i}", text()) for i in range(60)] + [("e", ""), ("n", None), ("s", "zz zz")]
    theirs = [(f"s{i}", text()) for i in range(25)] + [("n", None), ("e", "")]
    found = verification.supports(spark.createDataFrame(mine, "claim_id string, claim string").coalesce(1), spark.createDataFrame(theirs, "source_id string, sentence string"), keep=None)
    words = lambda t: {w for w in re.split(r"\s+", (t or "").lower()) if len(w) > 2}
    negative = lambda t: any(w in verification.NEGATION_WORDS for w in t.split())
    expected = {}
    for c, a in mine:
        for s, b in theirs:
            shared = len(words(a) & words(b))
            if shared and shared / len(words(a)) >= 0.2 and shared / len(words(a) | words(b)) >= 0.3:
                apart = any(0.1 < abs(x - y) / max(x, y, 1) < 1 for x in map(float, re.findall(r"\d+", a)) for y in map(float, re.findall(r"\d+", b)))
                expected[c, s] = (shared / len(words(a) | words(b)), negative(a) != negative(b) or apart)
    rows = found.collect()
    assert len(rows) == len(expected) and {(r["claim_id"], r["source_id"]): (r["relevance"], r["against"]) for r in rows} == expected
    for claim in {r["claim_id"] for r in rows}:
        ranked = sorted((r for r in rows if r["claim_id"] == claim), key=lambda r: (-r["relevance"], r["source_id"]))
        assert [r["place"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    texts = spark.createDataFrame([(i, "One sentence here. Another one there, and more.") for i in range(40)], "id int, text string").coalesce(1)
    assert verification.claim_sentences(texts).rdd.getNumPartitions() > 1
