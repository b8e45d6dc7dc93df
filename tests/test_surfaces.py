"""Files, repositories, databases, plugins, exporters and limiters."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris import plugins
from verdigris.operators import multimodal
from verdigris.sources import files, repositories
from verdigris.streaming import monitoring


def dataset(name, cases=((("c1"), "Say hi"),)):
    return json.dumps({"name": name, "version": "1", "test_cases": [{"id": i, "prompt": p} for i, p in cases]})


@pytest.fixture
def repository(tmp_path):
    yaml = "name: three\nversion: '1'\ntest_cases:\n  - id: a\n    prompt: |\n      Two\n      lines\n  - {id: b, prompt: 'x: y'}\n"
    for at, content in {
        "datasets/one.json": dataset("one"), "datasets/three.yaml": yaml, "datasets/bad.json": "{", "datasets/worse.yml": "a: [", "datasets/empty.json": dataset("empty", ()), "datasets/noid.json": dataset("noid", (("", "x"),)),
        "datasets/readme.md": "x", "data/four.json": dataset("four"), "five.yml": dataset("five"), "deep/er/six.json": dataset("six"),
    }.items():
        path = tmp_path / "repo" / at
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return str(tmp_path / "repo")


def test_a_folder_with_bad_files(spark, repository):
    good, bad = repositories.load_folder(spark, f"{repository}/datasets")
    assert sorted((r["name"], r["id"], r["prompt"]) for r in good.collect()) == [("one", "c1", "Say hi"), ("three", "a", "Two\nlines\n"), ("three", "b", "x: y")]
    assert {r["file"].rsplit("/", 1)[1]: r["problem"] for r in bad.collect()} == {"bad.json": "does not parse", "worse.yml": "does not parse", "empty.json": "no test cases", "noid.json": "a test case without id or prompt"}
    none, nothing = repositories.load_folder(spark, f"{repository}/no_such")
    assert none.count() == nothing.count() == 0


def test_repositories(spark, repository):
    names = lambda kind: sorted(r["dataset"] for r in repositories.discover(spark, kind, repository).collect())
    assert names("native") == ["bad", "empty", "noid", "one", "three", "worse"] and names("Generic") == ["five", "four", "one", "three"]
    assert repositories.load(spark, "native", repository, "three").count() == 2 and repositories.load(spark, "generic", repository, "five").count() == 1
    for kind, name in (("native", "four"), ("native", "bad"), ("generic", "six"), ("other", "one")):
        with pytest.raises(ValueError):
            repositories.load(spark, kind, repository, name)


def test_manifest_is_checked(tmp_path):
    good = {"fleet_id": "f", "repositories": [{"repo_id": "r", "scenarios": ["s"]}], "providers": ["p:m"], "scenario_profiles": {"s": {}}}
    at = tmp_path / "m.json"
    at.write_text(json.dumps(good))
    assert files.manifest(str(at))["fleet_id"] == "f"
    for change in ({"providers": []}, {"scenario_profiles": {"t": {}}}, {"fleet_id": ""}):
        at.write_text(json.dumps(good | change))
        with pytest.raises(ValueError):
            files.manifest(str(at))


def test_database(spark):
    at = {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    files.write_jdbc(spark.range(10).select("id", F.expr("nullif(concat('n', id), '')").alias("name")), table="T", **at)
    files.write_jdbc(spark.range(10, 12).select("id", F.lit(None).cast("string").alias("name")), table="T", **at)
    read = files.jdbc(spark, table="T", **at).where("id > 7")
    assert sorted((r["id"], r["name"]) for r in read.collect()) == [(8, "n8"), (9, "n9"), (10, None), (11, None)]
    assert "GreaterThan(id,7)" in read._jdf.queryExecution().toString()  # the database filters


def test_benchmarks_as_whole_files(spark, tmp_path):
    rows = spark.createDataFrame([("b1", "t2", 'say "x"'), ("b1", "t1", None), ("b2", "t1", "é")], "bench string, test_id string, said string")
    files.save_json(rows, ["bench"], str(tmp_path / "out"))
    written = [p.read_text() for p in (tmp_path / "out").glob("*.txt")]
    assert sorted(json.loads(t)["bench"] for t in written) == ["b1", "b2"] and all("\n" in t.strip() for t in written)
    back = files.load_json(spark, str(tmp_path / "out"), "bench STRING, total_tests BIGINT", "test_id: STRING, said: STRING")
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("b1", 2, "t2", 'say "x"'), ("b1", 2, "t1", None), ("b2", 1, "t1", "é")], key=str)


def test_fleet_in_every_format(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    views = {"summary": spark.createDataFrame([(1, 'a "b"\nc', None, 0.5)], "n int, text string, gone string, rate double")}
    files.fan_out(views, str(tmp_path), ["json", "yaml", "csv"])
    text = "".join(p.read_text() for p in (tmp_path / "yaml" / "summary").glob("*.txt"))
    assert yaml.safe_load(text) == [{"n": 1, "text": 'a "b"\nc', "gone": None, "rate": 0.5}]
    with pytest.raises(ValueError):
        files.fan_out(views, str(tmp_path / "other"), ["json", "xml"])
    assert not (tmp_path / "other").exists()


def test_command_formats(spark):
    row = spark.createDataFrame([("openai", "gpt-4-turbo", 0.987, 10.4, 20.6, 15.0, 0.12345)], "provider string, model string, success_rate double, p50 double, p95 double, mean double, total_cost double")
    assert [r["line"] for r in files.formatted(row, "table", "provider").collect()][2] == "| openai   | gpt-4 |        98.7% |       10 |       21 |        15 | $   0.1235 |"
    assert json.loads(files.formatted(row, "json").collect()[0]["line"])["provider"] == "openai"
    with pytest.raises(ValueError):
        files.formatted(row, "xml")


def test_decisions_are_read_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.6)], "id int, agent_id string, confidence double")
    for _ in range(2):
        files.persist_decisions(d, str(tmp_path / "d"))
    assert files.decisions(spark, str(tmp_path / "d")).count() == 2 and files.decisions(spark, str(tmp_path / "d"), "b").count() == 1


def test_plugins(spark):
    odd, twice = lambda df: df.where("id % 2 = 1"), lambda df, k: df.withColumn("id", F.col("id") * k)
    plugins.register("filter", "odd", odd)
    plugins.register("filter", "odd", odd)
    plugins.register("transform", "times", twice)
    plugins.register("filter", "bad", lambda df: df.withColumn("x", F.lit(1)))
    assert [r["id"] for r in plugins.apply(spark.range(4), ("filter", "odd"), ("transform", "times", 10)).collect()] == [10, 30]
    for chain in (("filter", "none"), ("evaluator", "odd"), ("filter", "bad")):
        with pytest.raises(ValueError):
            plugins.apply(spark.range(4), chain)
    for kind, f in (("filter", twice), ("poet", odd)):
        with pytest.raises(ValueError):
            plugins.register(kind, "odd", f)


def test_media(spark):
    message = spark.createDataFrame([([("text", "a"), ("image", "b"), ("text", "c")],), ([],)], f"parts array<{multimodal.PART}>")
    assert [tuple(r) for r in message.select(*multimodal.media_type_counts(F.col("parts"))).collect()] == [(2, 1, 0, 0), (0, 0, 0, 0)]
    scores = spark.createDataFrame([(0.5, 0.2), (None, 1.5), (0.4, None), (None, None)], "v double, w double")
    assert [r[0] for r in scores.select(multimodal.score(F.col("v"), F.col("w"))).collect()] == [0.65, 0.0, 0.4, 0.0]
    with pytest.raises(ValueError):
        multimodal.of_task(scores, "juggling")


def test_topics(spark):
    messages = spark.createDataFrame([("request.logs",), ("plugin.events",)], "topic string")
    assert monitoring.subscribed(messages, ["plugin.events"]).count() == 1
    with pytest.raises(ValueError):
        monitoring.subscribed(messages, ["weather"])


def test_sliding_counts_across_hours(spark):
    rng = np.random.default_rng(6)
    at = sorted(rng.integers(0, 4 * 3600, 300).tolist()) + [3599, 3600, 3600, 7199, 7200]
    rows = [(i, f"k{i % 2}", t) for i, t in enumerate(at)]
    events = spark.createDataFrame(rows, "id int, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for seconds in (60, 5000):
        got = {r["id"]: r["n"] for r in monitoring.recent_counts(events, "key", seconds, 3).collect()}
        assert got == {i: sum(k2 == k and t - seconds < t2 <= t for _, k2, t2 in rows) for i, k, t in rows}


def test_exporter_on_one_request(spark):
    names = "type string, id int, ts timestamp, provider string, model string, error_type string, latency double, input_tokens long, output_tokens long, cost double, metric string, score double, benchmark string, benchmark_name string, progress double"
    row = lambda kind, i, **k: (kind, i, None, "p", "m", k.get("error"), k.get("latency"), k.get("tokens"), 2, 0.5, "f", k.get("score"), "b", "n", None)
    e = spark.createDataFrame([row("request_started", 1), row("request_started", 2), row("request_completed", 3, latency=0.7, tokens=5), row("evaluation", 4, score=0.2), row("evaluation", 5, score=0.9)], names)
    got = {(r["name"], r["labels"]): r["value"] for r in monitoring.exporter(e).collect()}
    who = '{"provider":"p","model":"m"'
    assert got["llm_requests_active", '{"provider":"p"}'] == 1 and got["llm_requests_total", who + ',"status":"success"}'] == 1 and got["llm_tokens_input_total", who + "}"] == 5
    assert got["llm_request_duration_seconds_bucket", who + ',"le":"0.5"}'] == 0 and got["llm_request_duration_seconds_bucket", who + ',"le":"1.0"}'] == 1 and got["llm_request_duration_seconds_sum", who + "}"] == 0.7
    assert got["llm_evaluation_score", who + ',"metric":"f"}'] == 0.9
