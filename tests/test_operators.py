import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from verdigris.operators import benchmark, generation, inference, ranking, records, stress, verification
from verdigris.sources import builtin, files, report
from verdigris.streaming import monitoring

RESULT = "test_id string, provider string, model string, category string, repository string, status string, duration_ms long, prompt_tokens long, completion_tokens long, ts timestamp"


def results(spark, *rows):
    now = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(str(i), "p", "m", "c", r, s, d, a, b, now) for i, (r, s, d, a, b) in enumerate(rows)], RESULT)


def test_summary(spark):
    s = benchmark.summary(results(spark, ("r", "success", 100, 1000, 1000), ("r", "failure", 200, None, None), ("r", "timeout", 300, None, None)), []).first()
    assert s["success_rate"] == round(1 / 3, 6) and s["total_cost"] == 0.09 and s["total_tokens"] == 2000 and s["p50_duration_ms"] == 200


def test_summary_of_nothing(spark):
    s = benchmark.summary(results(spark).where("false"), []).first()
    assert s["total"] == 0 and s["success_rate"] == 0 and s["p95_duration_ms"] == 0


def test_fleet(spark):
    rows = [("a", "success", 1000, 1, 1)] * 10 + [("b", "success", 1100, 1, 1)] * 7 + [("b", "failure", 1200, None, None)] * 3 + [("c", "success", 1, 1, 1)] * 5 + [("c", "failure", 1, None, None)] * 5
    r = results(spark, *rows)
    fleet = benchmark.fleet_summary(r).first()
    assert fleet["succeeded"] == 22 and fleet["repositories"] == 3
    assert {x["kind"]: x["repository"] for x in benchmark.best_and_worst(r).collect()} == {"best": "a", "worst": "c"}
    assert [x["repository"] for x in benchmark.failing(r, 0.6).collect()] == ["c"]


def test_report_lists_every_failing_repository(spark, tmp_path):
    rows = [(f"r{i:02}<", "success" if k < 17 else "failure", 1, 1, 1) for i in range(45) for k in range(20)] + [("fine", "success", 1, 1, 1)]
    r = results(spark, *rows)
    page = report.executive_report(r)
    assert "Failing repositories, below 90% (45 found)" in page and "Providers (1 found)" in page
    assert re.findall(r"<td>(r\d\d&lt;)</td><td>0.8500</td><td>20</td>", page) == [f"r{i:02}&lt;" for i in range(45)]
    report.write_report(r, str(tmp_path / "report"))
    assert "".join(x for f in sorted((tmp_path / "report").glob("part-*")) for x in f.read_text().splitlines()) == page


def test_histogram_of_equal_values(spark):
    h = {x["bin"]: x["n"] for x in benchmark.histogram(results(spark, *[("r", "success", 5, 1, 1)] * 2), 3).collect()}
    assert h == {0: 2, 1: 0, 2: 0}


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        benchmark.metric(results(spark), "colour")


def test_stepped_test_is_significant_at_its_bound(spark):
    assert spark.range(1).select((inference.stepped_p(F.lit(2.0)) < F.lit(1.0) - F.lit(0.95)).alias("s")).first()["s"]


def test_single_runs_are_no_regression(spark):
    runs = spark.createDataFrame([("p", "m", "baseline", 1.0, 1.0, 1.0, 1.0), ("p", "m", "candidate", 9.0, 0.1, 0.1, 9.0)], "provider string, model string, side string, latency double, throughput double, success_rate double, cost double")
    found = inference.regressions(runs, ["provider", "model"]).collect()
    assert len(found) == 4 and not any(x["is_regression"] for x in found) and all(x["p_value"] == 1 for x in found)


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        ranking.check_weights({"a": 0.6, "b": 0.3})


def test_equal_latencies(spark):
    m = spark.createDataFrame([(1, "p", "a", True, 0.5, None, None, 100, 0.1), (2, "p", "b", True, 0.5, None, None, 100, 0.1)], "ordinal long, provider string, model string, success boolean, faithfulness double, relevance double, coherence double, latency_ms long, cost double")
    found = ranking.ranked(m).orderBy("rank").collect()
    assert [x["model"] for x in found] == ["a", "b"] and all(x["performance"] == 1 for x in found)


def test_breaking_pattern(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", "p", "m", level, i >= fails, None, 1, t, str(i)) for level, fails in ((1, 0), (2, 2), (3, 6)) for i in range(10)]
    r = spark.createDataFrame(rows, "scenario string, provider string, model string, level int, success boolean, failure_mode string, latency_ms long, ts timestamp, tie string")
    b = stress.breaking_points(r).first()
    assert (b["threshold"], b["first_failure_at"], b["pattern"]) == (3, 2, "gradual")


def test_verdicts(spark):
    claims = spark.createDataFrame([("1", "the quick brown foxes jumped"), ("2", "nothing alike")], "claim_id string, claim string")
    sources = spark.createDataFrame([("s", "the quick brown foxes jumped")], "source_id string, sentence string")
    found = verification.verdicts(claims, verification.supports(claims, sources))
    assert {x["claim_id"]: x["verdict"] for x in found.collect()} == {"1": "supported", "2": "not_supported"}


def test_golden_keeps_the_last_sample(spark):
    outputs = spark.createDataFrame([("a", "x"), ("b", "y")], "sample_id string, output string")
    samples = spark.createDataFrame([("a", "old", 1), ("a", "x", 2)], "sample_id string, golden string, ordinal int")
    m = verification.golden_match(verification.golden(outputs, samples)).collect()
    assert len(m) == 1 and m[0]["match"] == "exact_match"
    assert [x["sample_id"] for x in verification.mismatches(outputs, samples).collect()] == ["b"]


def test_records(spark):
    at = F.lit("2024-02-01").cast("timestamp")
    s = spark.createDataFrame([(1, "failed", dt.datetime(2023, 1, 1), None), (2, "pending", dt.datetime(2023, 1, 1), None)], "id long, status string, created_at timestamp, updated_at timestamp")
    changed = records.update(s, spark.createDataFrame([(2, "running")], "id long, status string"), at)
    assert {x["id"]: x["status"] for x in changed.collect()} == {1: "failed", 2: "running"}
    assert [x["id"] for x in records.cleanup(s, at, 30).collect()] == [2]


def test_builtin_datasets_are_whole(spark):
    rows = builtin.datasets(spark).collect()
    counts = {d: sum(r["dataset"] == d for r in rows) for d in builtin.DATASETS}
    assert counts == {"coding-tasks": 7, "reasoning-tasks": 5, "summarization-tasks": 4, "instruction-following": 6, "creative-writing": 6}
    assert all(set(re.findall(r"{{(\w+)}}", r["prompt"])) == set(r["variables"]) for r in rows)
    assert sum(bool(r["variables"]) for r in rows) == 15 and all(r["max_tokens"] > 0 for r in rows)


def test_every_strategy_generates(spark):
    names = ["template", "variation", "distribution_aware", "edge_case", "adversarial", "combinatorial", "progressive", "cross_domain"]
    made = {s: [(x["id"], x["difficulty"]) for x in generation.cases(spark, 60, 3, s).collect()] for s in names}
    assert all(len(rows) == 60 for rows in made.values())
    assert made["variation"] == made["distribution_aware"] == made["cross_domain"] == made["template"] != made["edge_case"]


def test_generation_repeats(spark):
    a, b = (generation.cases(spark, 50, 3).collect() for _ in range(2))
    assert a == b


def test_sources(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"name": "d", "version": "1", "test_cases": [{"id": "1", "prompt": "p"}, {"id": "", "prompt": "q"}]}')
    (tmp_path / "bad.json").write_text("{nope")
    found = files.datasets(spark, str(tmp_path)).cache()
    assert [x["id"] for x in files.test_cases(found).collect()] == ["1"] and files.bad_datasets(found).count() == 1
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "r.jsonl").write_text('{"test_id": "a", "duration_ms": 5}\n\n{broken\n')
    assert [x["test_id"] for x in files.results_jsonl(spark, str(lines)).collect()] == ["a"]


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, "error" if i % 3 == 0 else "click", dt.datetime(2024, 1, 1, 0, i % 60), "p", 1.0 * i, i, i, 0.1) for i in range(40)]
    events = spark.createDataFrame(rows, "id long, event_type string, ts timestamp, provider string, latency double, input_tokens long, output_tokens long, cost double")
    events.write.parquet(str(tmp_path / "in"))
    got = {}
    stream = monitoring.read_stream(spark, str(tmp_path / "in"), events.schema, 100)
    q = monitoring.publish(monitoring.tumbling(stream, "10 minutes"), lambda batch, n: got.update({(x["start"], x["event_type"]): x["requests"] for x in batch.collect()}), str(tmp_path / "cp"))
    q.awaitTermination()
    assert got == {(x["start"], x["event_type"]): x["requests"] for x in monitoring.tumbling(events, "10 minutes").collect()}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
