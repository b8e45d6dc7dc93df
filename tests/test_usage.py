"""Costs, confidence, health, sensitivity and verification by worked examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import edits, percentiles, running, similarity, text
from verdigris.functions import similarity as S
from verdigris.operators import confidence, consistency, contents, costs, generation, inference, metrics, ranking, records, search, sensitivity, stress, verification


def one(df):
    return df.collect()[0].asDict()


def test_savings_by_the_table(spark):
    rows = spark.createDataFrame([("gpt-4", "gpt-3.5-turbo"), ("unknown", "unknown"), ("gpt-4", "gpt-4")], "a string, b string")
    got = [round(r[0], 6) for r in rows.select(costs.savings(F.col("a"), F.col("b"), F.lit(100_000))).collect()]
    assert got == [575.0, 400.0, 0.0]  # 0.006 - 0.00025, and the defaults 0.006 - 0.002, each times 100,000


def test_prices_of_sources(spark):
    price = lambda s, p, m: one(spark.range(1).select(costs.request_price(s, F.lit(p), F.lit(m), F.lit(1000.0), F.lit(1000.0)).alias("x")))["x"]
    assert price("judge", "", "nobody") == pytest.approx(0.04) and price("comparison", "", "nobody") == pytest.approx(0.003)
    assert price("optimize command", "openai", "my-gpt-4-turbo") == pytest.approx(0.04) and price("optimize command", "openai", "my-gpt-4") == pytest.approx(0.09)
    assert price("compare command", "openai", "o1") == pytest.approx(0.0035) and price("runner agent", "", "nobody") == 0
    with pytest.raises(ValueError):
        price("nobody's", "", "")


def results(spark, n, prompt, completion, failed=0):
    rows = [("b", "success", prompt, completion)] * (n - failed) + [("b", "failure", None, None)] * failed
    return spark.createDataFrame(rows, "bench string, status string, prompt_tokens long, completion_tokens long")


def test_expensive_patterns_begin_above_their_bounds(spark):
    found = lambda *a: {r["pattern"]: r for r in costs.expensive_patterns(results(spark, *a), ["bench"]).collect()}
    assert found(10, 1000, 500).keys() == {"expensive_model"} and found(10, 100, 50) == {}
    long = found(10, 2000, 600)
    assert long["long_prompts"]["potential_savings"] == pytest.approx((2000 - 800) / 1000 * 0.03 * 10) and long["verbose_responses"]["potential_savings"] == pytest.approx(0.3 * 0.06 * 10)
    assert "expensive_model" not in found(10, 2000, 600, 1)  # nine of ten succeed
    assert found(10, 2000, 600, 5).keys() == set()  # means are over all tests, those without an answer too: 1,000 and 300
    titles = lambda *a: {r["title"] for r in costs.suggestions(results(spark, *a), ["bench"]).collect()}
    assert titles(101, 1001, 501) == {"Compress Long Prompts", "Set Response Length Limits", "Use Batch Processing", "Optimize Temperature Settings"}
    assert titles(100, 1000, 500) == {"Optimize Temperature Settings"} and titles(100, 1000, 500, 5) == set()


def test_benchmark_confidence(spark):
    of = lambda rate, mean, sd, n: one(spark.range(1).select(confidence.of_benchmark(F.lit(rate), F.lit(mean), F.lit(sd), F.lit(n)).alias("c")))["c"]
    assert of(1.0, 100.0, 0.0, 99) == pytest.approx(0.4 + 0.2 + 0.16 + 0.2)
    assert of(0.5, 100.0, 300.0, 9) == pytest.approx(0.2 + 0 + 0.16 + 0.1) and of(0.0, 0.0, 0.0, 0) == pytest.approx(0.16)


def test_stress_confidence_of_nothing(spark):
    none = spark.createDataFrame([], "test_type string, requests long, success_rate double, breaks boolean, recovered boolean")
    assert one(confidence.of_stress(none))["confidence"] == 0
    some = spark.createDataFrame([("a", 999, 1.0, False, True)], none.schema)
    assert one(confidence.of_stress(some))["confidence"] == pytest.approx(0.25 + 0.2 / 5 + 0.25 + 0.075 + 0.15)


@pytest.mark.parametrize(
    "workers,status",
    [
        ([("idle", 0, 4, 0), ("busy", 59, 4, 1)], "healthy"), ([("idle", 0, 4, 0), ("busy", 60, 4, 1)], "degraded"), ([("idle", 0, 10, 10)], "degraded"), ([("idle", 0, 10, 9)], "healthy"),
        ([("idle", 0, 4, 0)] * 99 + [("busy", 90, 4, 1)], "unhealthy"), ([("offline", 0, 4, 0)], "unhealthy"), ([("idle", 0, 0, 0)], "healthy"),
    ],
)
def test_cluster_health(spark, workers, status):
    now = F.lit("2001-01-01").cast("timestamp")
    w = spark.createDataFrame(workers, "status string, silent int, capacity int, tasks int").withColumn("heartbeat", now - F.make_interval(secs=F.col("silent").cast("decimal(18,6)")))
    assert one(records.cluster_health(w, now, 60, 90))["status"] == status


def test_faithfulness_counts_partial_support_and_documents(spark):
    judged = spark.createDataFrame([("a", "partially_supported"), ("b", "partially_supported")], "claim_id string, verdict string")
    sources = spark.createDataFrame([("1-0", "1"), ("1-1", "1"), ("2-0", "2")], "source_id string, document_id string")
    found = spark.createDataFrame([("a", "1-0"), ("a", "1-1"), ("b", "1-0")], "claim_id string, source_id string")
    none = judged.where("false")
    assert one(verification.faithfulness(judged, none, found, sources)) == {"claims": 2, "support": 1.0, "hallucination": 0.0, "contradiction": 0.0, "coverage": 0.5, "faithfulness": 0.95}
    assert one(verification.faithfulness(none, none, found.where("false"), sources.where("false"))) == {"claims": 0, "support": 1.0, "hallucination": 0.0, "contradiction": 0.0, "coverage": 0.0, "faithfulness": 0.9}


def test_hallucinations_by_kind_of_claim(spark):
    claims = spark.createDataFrame([("n", "There are 12 boats"), ("f", "The boat is blue"), ("g", "The boat is red"), ("t", "It sank during winter"), ("c", "It sank because of rain"), ("o", "I think it sank"), ("s", "fine")], "claim_id string, claim string")
    judged = spark.createDataFrame([("n", "not_supported", 0.7), ("f", "not_supported", 0.7), ("g", "unverifiable", 0.2), ("t", "not_supported", 0.7), ("c", "not_supported", 0.7), ("o", "not_supported", 0.7), ("s", "supported", 0.9)], "claim_id string, verdict string, confidence double")
    got = {r["claim_id"]: (r["type"], r["severity"]) for r in verification.claim_hallucinations(claims, judged).collect()}
    assert got == {"n": ("fabrication", "major"), "f": ("unsupported_inference", "major"), "g": ("fabrication", "critical"), "t": ("fabrication", "major"), "c": ("unsupported_inference", "major"), "o": ("unsupported_inference", "minor")}


def test_entities_that_no_source_has(spark):
    texts = spark.createDataFrame([(1, "Ada Lovelace met Grace Hopper in New York."), (2, "nobody here")], "id int, text string")
    sources = spark.createDataFrame([(1, "we know ADA LOVELACE and new york")], "reference_id int, reference string")
    assert [(r["id"], r["entity"]) for r in verification.fabricated_entities(texts, sources).collect()] == [(1, "Grace Hopper")]


def test_metric_values_of_every_shape(spark):
    shapes = {
        1: ('{"results":[{"duration_ms":5},{"duration_ms":6.5},{"duration_ms":"7"},{"x":1}],"summary":{"duration_ms":9}}', [5.0, 6.5]), 2: ('{"results":[{"x":1}],"summary":{"duration_ms":9}}', [9.0]),
        3: ('[{"results":[{"duration_ms":1}]},{"y":2},{"results":[{"duration_ms":2}]}]', [1.0, 2.0]), 4: ('{"duration_ms":3}', []), 5: ("not json", []), 6: (None, []), 7: ("[]", []),
    }
    files = spark.createDataFrame([(k, j) for k, (j, _) in shapes.items()], "id int, json string")
    assert {r["id"]: r["values"] for r in metrics.metric_values(files, "latency").collect()} == {k: v for k, (_, v) in shapes.items()}
    nested = spark.createDataFrame([(1, '{"results":[{"metrics":{"relevance":0.5}}]}')], "id int, json string")
    assert one(metrics.metric_values(nested, "relevance"))["values"] == [0.5] and metrics.path_of("cost") == "$.estimated_cost" and metrics.path_of("other") == "$.other"


def test_sensitivity_takes_successes_only(spark):
    runs = spark.createDataFrame([("p", 1, True, "a b", 10, 4), ("p", 2, True, "a c", 30, 6), ("p", 3, False, "zzz", 999, 999), ("q", 1, False, "a", 1, 1)], "kind string, ordinal int, success boolean, content string, latency_ms long, tokens long")
    base = spark.createDataFrame([("p", "A b")], "kind string, content string")
    got = {r["kind"]: r for r in sensitivity.aggregates(runs, base, ["kind"], ["kind"]).collect()}
    p = got["p"]
    assert (p["response_variance"], p["similarity_to_base"]) == (round(1 - 1 / 3, 6), round((1 + 1 / 3) / 2, 6)) and (p["avg_latency"], p["var_latency"], p["avg_tokens"], p["success_rate"]) == (20, 100, 5, 0.666667)
    assert (got["q"]["response_variance"], got["q"]["avg_latency"], got["q"]["success_rate"]) == (0, 0, 0)


def test_breaking_points_go_by_the_type(spark):
    rows = [(t, "p", "m", t, level, level * 100, level < 3, None, 1, None, "") for t in ("load_ramp", "extreme_input", "spike") for level in (1, 2, 3, 4) for _ in range(3)]
    requests = spark.createDataFrame(rows, "scenario string, provider string, model string, test_type string, level int, input_size int, success boolean, failure_mode string, latency_ms long, ts timestamp, tie string")
    got = {r["scenario"]: (r["metric"], r["threshold"], r["pattern"]) for r in stress.typed_breaking_points(requests).collect()}
    assert got == {"load_ramp": ("concurrency", 3, "gradual"), "extreme_input": ("input_size", 300, "cliff")}
    assert [r["scenario"] for r in stress.typed_recovery(requests).collect()] == ["spike"]


# whole-table order


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_running_sums(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2).tolist()
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(values)], "id int, v double, w long")
    got = {r["id"]: r["s"] for r in running.running_sum(df, "v", F.col("w"), "s", F.col("id")).collect()}
    order = sorted(range(n), key=lambda i: (values[i], i))
    assert got == {i: int(sum(j % 3 for j in order[: k + 1])) for k, i in enumerate(order)} if n < 100 else got[order[-1]] == sum(i % 3 for i in range(n)) and [got[i] for i in order] == np.cumsum([i % 3 for i in order]).tolist()


def test_percentiles_of_a_whole_table(spark):
    rng = np.random.default_rng(5)
    values = rng.lognormal(size=2001).round(3).tolist()
    got = one(percentiles.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", {"p50": ("rank", 0.5), "p95": ("nearest", 0.95), "m": ("middle", 0)}))
    s = sorted(values)
    assert got == {"p50": s[1000], "p95": s[int(np.ceil(0.95 * 2001)) - 1], "m": s[1000]}


def test_mann_whitney_of_tied_doubles(spark):
    a, b = [1.5, 2.5, 2.5, 9.0], [2.5, 0.5, 3.5]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "s string, v double")
    u1 = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert one(inference.mann_whitney(df, "s", "a", "b", "v"))["u"] == min(u1, len(a) * len(b) - u1)


def test_profiles_fold_over_batches(spark):
    rows = [(k % 3, i, i, (i % 7) / 7, i * 10 % 97) for k in range(3) for i in range(50)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = {r["model"]: r for r in ranking.smoothed_profiles(spark.createDataFrame(rows, "model long, ts int, tie int, quality double, latency long")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    q, l = 0.0, 0.0
    for i in range(50):
        x, y = (i % 7) / 7, i * 10 % 97
        q, l = (x, float(y)) if i == 0 else (q * 0.9 + x * 0.1, float(int(l * 0.9 + y * 0.1)))
    assert len(got) == 3 and all((r["quality"], r["latency_ms"], r["samples"]) == (round(q, 6), int(l), 50) for r in got.values())


# texts and vectors


def test_syllables_of_a_text_are_those_of_its_words(spark):
    rng = np.random.default_rng(2)
    signs = list("aeiouybcdlle'’ é.-_9\n") + ["le", "the", "l'e", "table", "'s", "e"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(600)] + ["", "e", "'", "be the table", "rhythm's", "l'île", "TABLE Le"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", text.letter_words(F.col("t")))
    each = F.aggregate(F.transform("w", text.syllables), F.lit(0), lambda a, x: a + x)
    bad = df.select("t", text.syllable_total(F.col("t")).alias("a"), each.alias("b")).where("a != b").collect()
    assert not bad, bad[:3]


def test_word_errors_of_very_many_words(spark):
    a = " ".join(f"w{i}" for i in range(40_000))
    df = similarity.with_word_error_rate(spark.createDataFrame([(a, "x " + a)], "a string, b string"), "a", "b", "wer")
    assert one(df.select("wer"))["wer"] == pytest.approx(1 / 40_000)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "NUMBERS_IN_BLOCK", 40)
    monkeypatch.setattr(search, "PRODUCTS_AT_ONCE", 30)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(120)] + [(200, [0.0] * 6), (201, None), (202, [1.0, 2.0]), (203, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 10 = 0 OR vec_id > 199").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for least in (0.3, -1.0):
        got = {(r["query_id"], r["vec_id"]): r["cosine"] for r in search.similar_vectors(vectors, queries, least).collect()}
        expected = {}
        for q, a in rows:
            for v, b in rows:
                if (q % 10 == 0 or q > 199) and a is not None and b is not None and len(a) == len(b) > 0:
                    x, y = np.float32(a).astype(float), np.float32(b).astype(float)
                    n = np.linalg.norm(x) * np.linalg.norm(y)
                    if (c := round(float(x @ y / n), 6) if n else 0.0) >= least:
                        expected[q, v] = c
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 2e-6 for k in got)


def test_mean_cosine_without_pairs(spark):
    outputs = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "x y"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "x"), ("d", 1, ""), ("d", 2, "x"), ("e", 1, ""), ("e", 2, " ")], "group_id string, ordinal int, content string")
    assert {r["group_id"]: r["cosine"] for r in consistency.tfidf_cosine(outputs).collect()} == {"a": 1.0, "b": 0.0, "c": 1.0, "d": 0.0, "e": 0.0}


def test_pairs_of_large_groups_are_dealt_out(spark, monkeypatch):
    outputs = spark.createDataFrame([("a", i, f"x{i % 7}") for i in range(40)] + [("b", 1, "x"), ("c", 1, None), ("c", 2, "y")], "group_id string, ordinal int, content string")
    monkeypatch.setattr(consistency, "OUTPUTS_AT_ONCE", 6)
    got = [(r["group_id"], r["i"], r["j"]) for r in consistency.pairs(outputs).collect()]
    assert sorted(got) == sorted([("a", i, j) for i in range(40) for j in range(i + 1, 40)] + [("c", 1, 2)])


def test_mean_likeness_of_hot_groups(spark):
    """Equal outputs count as often as they occur, and pairs that share nothing count too."""
    rng = random.Random(3)
    words = ["a", "bc", "river", "bridge", "the", "old"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randrange(5))) for _ in range(12)] + ["", "q", "zz"]
    rows = [("hot", i, rng.choice(some)) for i in range(60)] + [("same", i, "one text") for i in range(5)] + [("two", 1, "q"), ("two", 2, "zz"), ("single", 1, "x"), ("null", 1, None), ("null", 2, None)]
    got = {r["group_id"]: r for r in consistency.pair_similarity(spark.createDataFrame(rows, "group_id string, ordinal int, content string")).collect()}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    twos = lambda t: {tuple(w[i : i + 2]) for w in [t.split(" ")] for i in range(len(w) - 1)}
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    assert got.keys() == {"hot", "same", "two"}
    for g, r in got.items():
        texts = [t.strip() for k, _, t in rows if k == g]
        both = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]]
        mean = lambda f: sum(f(a, b) for a, b in both) / len(both)
        assert (r["pairs"], r["all_equal"]) == (len(both), len(set(texts)) == 1)
        assert abs(r["char_3gram"] - mean(lambda a, b: jaccard(grams(a), grams(b)))) < 2e-6
        assert abs(r["word_2gram"] - mean(lambda a, b: jaccard(twos(a), twos(b)))) < 2e-6
        assert abs(r["levenshtein"] - mean(lambda a, b: 1 - edits.edits(a, b) / max(len(a), len(b)) if a or b else 1.0)) < 2e-6


def test_a_hundred_thousand_outputs_have_an_exact_mean(spark):
    outputs = spark.range(100_000).select(F.lit("g").alias("group_id"), F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("text number "), (F.col("id") % 4).cast("string")).alias("content"))
    got = consistency.set_similarity(outputs).first()
    n, m = 100_000, 25_000
    same, apart = 4 * m * (m - 1) / 2, 6 * m * m
    assert got["pairs"] == n * (n - 1) // 2
    assert abs(got["char_3gram"] - (same + apart * 10 / 12) / got["pairs"]) < 2e-6 and abs(got["word_2gram"] - (same + apart / 3) / got["pairs"]) < 2e-6


# generated content


def test_seeded_states(spark):
    state, expected = 7, []
    for _ in range(200):
        expected.append(state)
        state = (state * 1103515245 + 12345) & 0x7FFFFFFF
    assert [r["s"] for r in spark.range(200).orderBy("id").select(generation.lcg(7, F.col("id")).alias("s")).collect()] == expected


def test_every_type_of_content(spark):
    cases = spark.range(30).withColumn("difficulty", F.element_at(F.array(*map(F.lit, contents.LEVELS)), (F.col("id") % 3 + 1).cast("int")))
    assert len(contents.ITEMS) == 10
    for kind in contents.ITEMS:
        made = contents.drawn(cases, kind, 5).select("id", "difficulty", F.get_json_object("content", "$.difficulty").alias("d"), F.contains("content", F.lit("{n}")).alias("open")).collect()
        assert all(r["d"] == r["difficulty"] and not r["open"] for r in made)
    with pytest.raises(ValueError):
        contents.content("poem", F.lit("easy"), F.lit(1))


def test_adversarial_prompts_are_capped_and_distinct(spark):
    rows = [(1, "b", "low", "same", "v"), (2, "a", "high", "same", "w"), (3, "a", "low", "one", "v"), (4, "a", "low", "two", "v"), (5, "a", "low", "three", "v"), (6, "z", "low", "unasked", "v")]
    templates = spark.createDataFrame(rows, "template_id int, category string, severity string, text string, attack_vector string")
    made = lambda most: [(r["place"], r["template_id"]) for r in contents.adversarial(templates, ["a", "b"], ["low", "high"], 2, most).orderBy("place").collect()]
    assert made(10) == [(1, 3), (2, 4), (3, 2)] and made(2) == [(1, 3), (2, 4)]
    m = one(contents.generation_metrics(contents.adversarial(templates, ["a", "b"], ["low", "high"], 2, 10), 4, ["a", "b"]))
    assert (m["total"], m["filtered"], m["diversity"], m["coverage"], m["low"]) == (3, 1, 1.0, 0.5, 0.666667)


def test_perturbations_by_index(spark):
    prompts = spark.createDataFrame([(1, "Say this. Then that!"), (2, "No marks")], "id int, text string")
    got = {(r["id"], r["kind"], r["index"]): r["prompt"] for r in generation.perturbed(prompts, (0, 1, 5)).collect()}
    assert got[1, "paraphrase", 0] == "Please say this. Then that!" and got[1, "paraphrase", 5] == "I would like you to say this. Then that!"
    assert got[1, "detail_reduction", 0] == "Say this." and got[1, "detail_reduction", 1] == "Say this. Then that!" and got[2, "detail_reduction", 0] == "No marks"
    assert got[1, "order_change", 0] == "! Then that.Say this" and got[2, "order_change", 0] == "No marks" and got[1, "emphasis_change", 1] == "IMPORTANT: Say this. Then that!"
    assert len(got) == 2 * 8 * 3


def test_extreme_inputs(spark):
    got = {(r["size"], r["kind"]): r["text"] for r in spark.range(1).select(F.inline(generation.extreme([0, 3, 30], ("ascii", "emoji", "mixed", "none")))).collect()}
    assert got[3, "ascii"] == got[3, "none"] == "ABC" and got[3, "emoji"] == "😀" and got[30, "ascii"] == "ABCDEFGHIJKLMNOPQRSTUVWXYZABCD"
    assert len(got[30, "mixed"]) == 30 and got[3, "mixed"] == "AB一" and all(got[0, k] == "" for k in ("ascii", "emoji", "mixed"))


def test_judges_answers(spark):
    said = {
        1: '{"score": 0.85, "reasoning": "Good", "confidence": 0.9}', 2: 'Here:\n{"score": 1, "reasoning": "x {y}"}\nDone.', 3: '{"score": 1.5, "reasoning": "r"}', 4: '{"score": "0.5", "reasoning": "r"}',
        5: '{"score": 0.5}', 6: "nothing", 7: None, 8: '{"score": 0.5, "reasoning": 3}', 9: '{"score": 0, "reasoning": "r", "confidence": "sure"}', 10: "} then {", 11: '{"reasoning": "r"}', 12: '{"score": -0.1, "reasoning": "r"}', 13: "",
    }
    got = {r["id"]: (r["problem"], r["score"], r["reasoning"], r["confidence"]) for r in verification.judged_answers(spark.createDataFrame(list(said.items()), "id int, answer string"), "answer").drop("answer").collect()}
    no = lambda why: (why, None, None, None)
    assert got == {
        1: (None, 0.85, "Good", 0.9), 2: (None, 1.0, "x {y}", 1.0), 3: no("score out of range"), 4: no("no score"), 5: no("no reasoning"), 6: no("no JSON"), 7: no("no JSON"), 8: no("no reasoning"),
        9: (None, 0.0, "r", 1.0), 10: no("no JSON"), 11: no("no score"), 12: no("score out of range"), 13: no("no JSON"),
    }


def test_pooled_effect(spark):
    rows = spark.createDataFrame([(3, 1.0, 1.0, 5, 2.0, 2.0), (1, 1.0, 0.0, 1, 2.0, 0.0), (4, 1.0, 0.0, 4, 3.0, 0.0)], "n1 int, mean1 double, sd1 double, n2 int, mean2 double, sd2 double")
    assert [round(r[0], 9) for r in rows.select(inference.pooled_effect()).collect()] == [round(1 / (18 / 6) ** 0.5, 9), 0, 0]


def test_improvement_is_a_lower_mean(spark):
    rng = np.random.default_rng(4)
    samples = {"lower": (rng.normal(10, 1, 40), rng.normal(8, 2, 30)), "higher": (rng.normal(8, 1, 40), rng.normal(10, 2, 30)), "same": (rng.normal(8, 3, 12), rng.normal(8, 3, 9)), "one": (np.array([1.0]), np.array([2.0, 3.0]))}
    rows = [(g, len(a), float(a.mean()), float(a.var(ddof=1)) if len(a) > 1 else 0.0, len(b), float(b.mean()), float(b.var(ddof=1))) for g, (a, b) in samples.items()]
    got = {r["g"]: r for r in inference.improvement(spark.createDataFrame(rows, "g string, n1 int, mean1 double, var1 double, n2 int, mean2 double, var2 double")).collect()}
    assert {g: r["improved"] for g, r in got.items()} == {"lower": True, "higher": False, "same": False}
    for g, r in got.items():
        a, b = samples[g]
        t = (a.mean() - b.mean()) / (a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)) ** 0.5
        d = (a.mean() - b.mean()) / (((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)) ** 0.5
        assert abs(r["t"] - t) < 1e-9 and (r["p_value"] < 0.05) == (abs(t) > 2.1)
        start = "Significant" if r["improved"] else "No significant"
        assert r["interpretation"] == f"{start} improvement (p={r['p_value']:.4f}, d={d:.2f})"


def test_blocks_compare_each_pair_of_a_group_once(spark, monkeypatch):
    """Groups of many blocks, long texts, characters beyond the first plane, nulls and empty texts, against plain sets."""
    monkeypatch.setattr(consistency, "OUTPUTS_IN_BLOCK", 2)
    monkeypatch.setattr(consistency, "BLOCKS_AT_ONCE", 3)
    rng = random.Random(5)
    some = ["", "ab", "abab", "😀😃😀😃x", "日本語の文", None, "x" * 30_000] + ["".join(rng.choice("ab cé😀") for _ in range(rng.randrange(40))) for _ in range(20)]
    rows = [("hot", i, rng.choice(some)) for i in range(50)] + [("two", 7, "abcdef"), ("two", 3, "abcxef"), ("one", 1, "x"), (None, 1, "x"), (None, 2, "x")]
    outputs = spark.createDataFrame(rows, "group_id string, ordinal int, content string")
    grams = lambda t, n: {t[i : i + n] for i in range(len(t or "") - n + 1)}
    jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0

    def weighted(a, b):
        if a == b and a is not None:
            return 1.0
        both = [(w, jaccard(grams(a, n), grams(b, n))) for n, w in S.NGRAM_WEIGHTS.items() if grams(a, n) and grams(b, n)]
        return sum(w * j for w, j in both) / sum(w for w, _ in both) if both else 0.0

    for measure, plain in ((S.strict_ngrams, lambda a, b: jaccard(grams(a, 3), grams(b, 3))), (S.weighted_ngrams, weighted)):
        got = [tuple(r) for r in consistency.pair_measure(outputs, measure, "s").select("group_id", "i", "j", "s").collect()]
        expected = {(g, i, j): plain(a, b) for g, i, a in rows for h, j, b in rows if g and g == h and i < j}
        assert len(got) == len(expected) and all(abs(s - expected[g, i, j]) < 1e-9 for g, i, j, s in got)
