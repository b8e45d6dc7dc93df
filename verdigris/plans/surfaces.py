"""Queries and SQL: files and formats, repositories, plugins, exporters, topics, typed stress tests, generated content."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from verdigris import plugins
from verdigris.functions.storage import scratch, stored
from verdigris.operators import benchmark, bias, contents, generation, multimodal, records, stress
from verdigris.plans import inference as P
from verdigris.plans.fixtures import RESULTS, results, table
from verdigris.plans.records import EVENTS, events
from verdigris.sources import files, repositories, snapshots
from verdigris.streaming import monitoring

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# files


@query("SRC4_result_json", f"WITH {RESULTS} SELECT run_key % 40 AS benchmark, count(*) OVER (PARTITION BY run_key % 40) AS total_tests, test_id, status, duration_ms FROM r")
def src4(spark, sf):
    """Whole benchmarks written as one JSON object each, and read back."""
    at = f"{scratch(spark)}/benchmarks"
    files.save_json(results(spark, sf).select(F.pmod("run_key", F.lit(40)).alias("benchmark"), "test_id", "status", "duration_ms"), ["benchmark"], at)
    return files.load_json(spark, at, "benchmark BIGINT, total_tests BIGINT", "test_id: STRING, status: STRING, duration_ms: BIGINT")


@query(
    "SNK2_pretty_json",
    "SELECT n_regionkey AS region, '{' || chr(10) || '  \"region\" : ' || n_regionkey || ',' || chr(10) || '  \"total_tests\" : ' || count(*) || ',' || chr(10) || '  \"results\" : [ ' || string_agg('{' || chr(10) || '    \"test_id\" : ' || n_nationkey || ',' || chr(10) || '    \"name\" : \"' || n_name || '\"' || chr(10) || '  }', ', ' ORDER BY n_nationkey) || ' ]' || chr(10) || '}' AS json FROM nation GROUP BY n_regionkey",
)
def snk2(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("test_id"), F.col("n_name").alias("name"))
    return files.benchmark_json(n, ["region"])


def fleet(spark, sf):
    r = stored(results(spark, sf).select(*benchmark.SUMMED))  # joined once for all views
    return {"summary": benchmark.fleet_summary(r), "repositories": benchmark.rates(r), "providers": benchmark.breakdown(r, "provider"), "categories": benchmark.breakdown(r, "category")}


@query(
    "SNK7_fleet_fan_out",
    f"""WITH {RESULTS}, c AS (SELECT 'summary' AS view, 1 AS n UNION ALL SELECT 'repositories', count(DISTINCT repository) FROM r UNION ALL SELECT 'providers', count(DISTINCT provider) FROM r UNION ALL SELECT 'categories', count(DISTINCT category) FROM r)
    SELECT f AS format, view, CAST(CASE f WHEN 'yaml' THEN n * CASE view WHEN 'summary' THEN 17 WHEN 'repositories' THEN 3 ELSE 9 END ELSE n END AS BIGINT) AS lines FROM c, (VALUES ('csv'), ('json'), ('yaml')) t(f)""",
)
def snk7(spark, sf):
    """Every view in every format, and how many lines each has."""
    at = f"{scratch(spark)}/fleet"
    written = files.fan_out(fleet(spark, sf), at, ["csv", "json", "yaml"])
    lines = lambda path: spark.read.option("header", True).csv(path) if "/csv/" in path else spark.read.text(path)
    out = None
    for path in written:
        how, view = path.split("/")[-2:]
        one = lines(path).agg(F.count("*").alias("lines")).select(F.lit(how).alias("format"), F.lit(view).alias("view"), "lines")
        out = one if out is None else out.unionByName(one)
    return out


def agent_runs(spark, sf):
    r = results(spark, sf)
    dollars = F.round(benchmark.cost(), 6).cast("decimal(12,6)")
    return r.select("test_id", F.lit(1).alias("iteration"), F.col("provider").alias("provider_name"), F.col("model").alias("model_id"), (F.col("status") == "success").alias("success"), F.col("duration_ms").alias("latency_ms"), "prompt_tokens", "completion_tokens", dollars.alias("cost_usd"))


@query(
    "SNK12_agent_csv",
    f"""WITH {RESULTS} SELECT test_id || ',1,' || provider || ',' || model || ',' || CASE WHEN status = 'success' THEN 'true' ELSE 'false' END || ',' || duration_ms || ',' || coalesce(prompt_tokens::VARCHAR, '') || ',' || coalesce(completion_tokens::VARCHAR, '') || ',' || coalesce(CAST(CAST(round(cost, 6) AS DECIMAL(12, 6)) AS VARCHAR), '') AS line FROM rc
    UNION ALL SELECT '{",".join(files.AGENT_CSV)}'""",
)
def snk12(spark, sf):
    return files.formatted(agent_runs(spark, sf), "csv", "test_id").select("line")


@query(
    "SNK12_agent_table",
    f"""WITH {RESULTS}, k AS (SELECT provider, model, count(*) FILTER (status = 'success') / count(*)::DOUBLE AS rate, list_sort(list(duration_ms) FILTER (status = 'success')) AS l, avg(duration_ms) FILTER (status = 'success') AS mean, sum(cost) AS cost FROM rc GROUP BY ALL),
    s AS (SELECT provider, model, round(rate, 6) AS rate, coalesce(l[greatest(1, CAST(ceil(0.5 * len(l)) AS BIGINT))], 0) AS p50, coalesce(l[greatest(1, CAST(ceil(0.95 * len(l)) AS BIGINT))], 0) AS p95, round(coalesce(mean, 0.0), 6) AS mean, round(coalesce(cost, 0.0), 6) AS cost FROM k)
    SELECT printf('| %-8s | %-5s | %11.1f%% | %8.0f | %8.0f | %9.0f | $%9.4f |', provider, model[1:5], rate * 100, p50::DOUBLE, p95::DOUBLE, mean, cost) AS line FROM s UNION ALL VALUES ('{files.AGENT_TABLE[0]}'), ('{files.AGENT_TABLE[1]}')""",
)
def snk12b(spark, sf):
    """The aggregated statistics of models, as the command prints them."""
    s = benchmark.model_stats(results(spark, sf)).withColumnsRenamed({"latency_p50": "p50", "latency_p95": "p95", "latency_mean": "mean"})
    return files.formatted(s, "table", "provider", "model").select("line")


@query("SNK11_decisions", "SELECT event_id AS id, event_type AS agent_id, value AS confidence FROM events WHERE event_type = 'click'")
def snk11(spark, sf):
    """Decisions appended twice, as by a retry, and read for one agent."""
    at = f"{scratch(spark)}/decisions"
    d = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("agent_id"), F.col("value").alias("confidence"))
    files.persist_decisions(d, at)
    files.persist_decisions(d, at)
    return files.decisions(spark, at, "click")


def write_datasets(spark, sf, at: str) -> None:
    """A repository of dataset files: one for each nation, JSON and YAML by turns, and some that are bad."""
    n = table(spark, sf, "nation")
    case = F.struct(F.lit("c1").alias("id"), F.concat(F.lit("Describe "), "n_name").alias("prompt"))
    k = F.col("n_nationkey")
    whole = F.to_json(F.struct(F.concat(F.lit("set-"), k).alias("name"), F.lit("1.0").alias("version"), F.array(case).alias("test_cases")))
    text = F.when(k == 3, "{broken").when(k == 7, F.replace(whole, F.lit('"c1"'), F.lit('""'))).when(k == 25, "not a dataset").otherwise(whole)
    extra = n.limit(1).withColumn("n_nationkey", F.lit(25))
    n.unionByName(extra).select(k.alias("k"), text.alias("value")).repartition(1).write.partitionBy("k").text(f"{at}/.parts")
    for key in range(25):
        move(spark, f"{at}/.parts/k={key}", f"{at}/{'datasets' if key % 3 else 'data'}/set-{key}.{'yaml' if key % 2 else 'json'}")
    move(spark, f"{at}/.parts/k=25", f"{at}/datasets/notes.txt")


def move(spark, folder: str, to: str) -> None:
    """The one part file of ``folder`` under a name of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.sc().hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(path(to).getParent())
    fs.rename(part, path(to))


@query("SRC2_dataset_folder", "SELECT 'set-' || n_nationkey AS name, 'c1' AS id, 'Describe ' || n_name AS prompt FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey <> 7")
def src2(spark, sf):
    """A folder of JSON and YAML datasets; the bad ones are left out."""
    at = scratch(spark)
    write_datasets(spark, sf, at)
    good, _ = repositories.load_folder(spark, f"{at}/datasets")
    return good.select("name", "id", "prompt")


@query("SRC2_bad_files", "SELECT 'set-7.yaml' AS file, 'a test case without id or prompt' AS problem")
def src2b(spark, sf):
    at = scratch(spark)
    write_datasets(spark, sf, at)
    _, bad = repositories.load_folder(spark, f"{at}/datasets")
    return bad.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "problem")


@query(
    "SRC8_repositories",
    "SELECT 'native' AS kind, 'set-' || n_nationkey AS dataset FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'generic', 'set-' || n_nationkey FROM nation WHERE n_nationkey NOT IN (3, 7)",
)
def src8(spark, sf):
    """A native repository's files by name; a generic one's that hold good datasets, wherever it keeps them."""
    at = scratch(spark)
    write_datasets(spark, sf, at)
    found = [repositories.discover(spark, kind, at).select(F.lit(kind).alias("kind"), "dataset") for kind in ("native", "generic")]
    return found[0].unionByName(found[1])


def database(spark) -> dict | None:
    """An embedded database in this JVM, where tasks run in it too; executors of their own cannot reach it."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        return None
    return {"url": f"jdbc:derby:memory:v{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@query("SNK8_jdbc_upsert", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'changed' ELSE n_name END AS name FROM nation WHERE n_nationkey >= 10")
def snk8(spark, sf):
    """Rows inserted into a database, some changed, and read again with the filter pushed down to it. Without a database that all executors
    reach, the table is one of files."""
    at = database(spark)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    changes = lambda stored: stored.where("id % 5 = 0").select("id", F.lit("changed").alias("name"))
    if at is None:
        folder = f"{scratch(spark)}/nation"
        snapshots.upsert(n.where("id % 2 = 0"), ["id"], 1, folder)
        snapshots.upsert(n.where("id % 2 = 1"), ["id"], 2, folder)
        snapshots.upsert(changes(snapshots.read(spark, folder)), ["id"], 3, folder)
        return snapshots.read(spark, folder).where("id >= 10").select("id", "name")
    files.write_jdbc(n.where("id % 2 = 0"), table="NATION", **at)
    files.write_jdbc(n.where("id % 2 = 1"), table="NATION", **at)
    stored = files.jdbc(spark, table="NATION", **at).select(F.col("id"), F.col("name"))
    changed = records.update(stored, changes(stored), F.current_timestamp())
    files.write_jdbc(changed, table="CHANGED", mode="overwrite", **at)
    return files.jdbc(spark, table="CHANGED", **at).where("id >= 10").select(F.col("id"), F.col("name"))


@query(
    "SNK8_keyed_upsert",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal::DOUBLE END AS score
    FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""",
)
def snk8_keyed(spark, sf):
    """Runs inserted or updated by key; nulls keep what is there, and a run that comes again changes nothing."""
    at = f"{scratch(spark)}/customer_runs"
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("pending").alias("status"), F.col("c_acctbal").cast("double").alias("score"))
    none = {k: F.lit(None).cast(kind) for k, kind in (("name", "string"), ("score", "double"))}
    done = c.where("id % 2 = 0").withColumns(none | {"status": F.lit("completed")})
    for run, rows in ((1, c.where("id % 3 <> 0")), (2, done), (2, done.withColumn("status", F.lit("late")))):
        snapshots.upsert(rows, ["id"], run, at)
    return snapshots.read(spark, at).select("id", "name", "status", "score")


MANIFEST = {
    "fleet_id": "nightly", "providers": ["openai:gpt-4", "local", "a:b:c"], "scenario_profiles": {"quick": {}, "long": {}},
    "repositories": [{"repo_id": "r1", "scenarios": ["quick", "long"]}, {"repo_id": "r2", "scenarios": ["long"]}, {"repo_id": "r3", "scenarios": []}],
}


@query(
    "SRC7_fleet_plan",
    "SELECT r AS repo_id, s AS scenario, p AS provider, m AS model FROM (VALUES ('r1', 'quick'), ('r1', 'long'), ('r2', 'long')) a(r, s), (VALUES ('openai', 'gpt-4'), ('local', ''), ('a', 'b:c')) b(p, m)",
)
def src7(spark, sf):
    """What a manifest asks to be run, read from a file of it and checked."""
    with tempfile.TemporaryDirectory() as folder:  # the driver reads manifests, nobody else
        at = os.path.join(folder, "fleet.json")
        with open(at, "w", encoding="utf-8") as out:
            json.dump(MANIFEST, out)
        return files.fleet_plan(spark, files.manifest(at))


# plugins


@query("UDF2_plugins", f"WITH {RESULTS} SELECT provider, count(*) AS n, max(duration_ms / 1000.0)::DOUBLE AS slowest FROM r WHERE status <> 'skipped' AND duration_ms >= 50000 GROUP BY provider")
def udf2(spark, sf):
    """A transform and two filters, registered and chained by name."""
    for kind, name, f in PLUGINS:
        plugins.register(kind, name, f)
    seen = plugins.apply(results(spark, sf), ("filter", "without_skipped"), ("filter", "slower_than", 50_000), ("transform", "in_seconds"))
    return seen.groupBy("provider").agg(F.count("*").alias("n"), F.max("seconds").alias("slowest"))


PLUGINS = (
    ("filter", "without_skipped", lambda df: df.where("status != 'skipped'")), ("filter", "slower_than", lambda df, ms: df.where(F.col("duration_ms") >= ms)),
    ("transform", "in_seconds", lambda df: df.withColumn("seconds", F.col("duration_ms") / 1000)),
)


# media


def messages(spark, sf):
    t = F.col("turn")
    parts = [F.struct(F.lit("text").alias("kind"), F.col("text").alias("content"))] + [F.when(t % k == 0, F.struct(F.lit(m).alias("kind"), F.lit("x").alias("content"))) for m, k in (("image", 2), ("audio", 3), ("video", 5))]
    return table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.array(*parts), lambda p: p.isNotNull()).alias("parts"))


@query("AGG29_media_counts", "SELECT conv_id, turn, 1 AS text, CAST(turn % 2 = 0 AS INT) AS image, CAST(turn % 3 = 0 AS INT) AS audio, CAST(turn % 5 = 0 AS INT) AS video FROM conversations")
def agg29(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", *multimodal.media_type_counts(F.col("parts")))


def examples(spark, sf):
    at = F.element_at(F.array(*map(F.lit, multimodal.TASKS)), (F.col("turn") % len(multimodal.TASKS) + 1).cast("int"))
    return messages(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("id"), at.alias("task"), F.struct("parts").alias("input"), F.lit("x").alias("expected_output"), F.lit(None).cast("string").alias("metadata"))


TASK = "CASE turn % 11 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(multimodal.TASKS)) + " END"


@query("SRC11_multimodal_datasets", f"SELECT conv_id || '-' || turn AS id, CAST(1 + (turn % 2 = 0)::INT + (turn % 3 = 0)::INT + (turn % 5 = 0)::INT AS INT) AS parts FROM conversations WHERE {TASK} = 'ocr'")
def src11(spark, sf):
    """Examples written as JSON and read back; one task's."""
    at = f"{scratch(spark)}/examples"
    examples(spark, sf).write.json(at)
    read = spark.read.schema(multimodal.EXAMPLE.replace("input struct", "input STRUCT")).json(at)
    return multimodal.of_task(read, "ocr").select("id", F.size("input.parts").alias("parts"))


@query("AGG25_task_distribution", f"SELECT {TASK} AS task, count(*) AS n FROM conversations GROUP BY 1")
def agg25(spark, sf):
    return multimodal.task_distribution(examples(spark, sf))


@query(
    "UDF4_multimodal_score",
    "WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN (length(text) % 100) / 100.0 END AS v, CASE WHEN turn % 3 = 0 THEN (length(text) % 150) / 100.0 END AS w FROM conversations) SELECT conv_id, turn, round(coalesce(list_avg(list_filter([v::DOUBLE, greatest(0, 1 - w)::DOUBLE], lambda x: x IS NOT NULL)), 0.0), 6) AS score FROM (SELECT conv_id, turn, v, w FROM s WHERE w IS NOT NULL UNION ALL SELECT conv_id, turn, v, NULL FROM s WHERE w IS NULL AND v IS NULL) UNION ALL SELECT conv_id, turn, round(v::DOUBLE, 6) FROM s WHERE w IS NULL AND v IS NOT NULL",
)
def udf4(spark, sf):
    """A vision score for every other turn, an error rate for every third."""
    n, t = F.char_length("text"), F.col("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(multimodal.score(F.when(t % 2 == 0, n % 100 / 100), F.when(t % 3 == 0, n % 150 / 100)), 6).alias("score"))


# monitoring


def exported(spark, sf):
    """Kinds of events by their type; signups are evaluations, purchases progress or ends of benchmarks."""
    e, t = events(spark, sf), F.col("event_type")
    kind = F.when(t == "view", "request_started").when(t == "click", "request_completed").when(t == "error", "request_failed").when(t == "signup", "evaluation").when(F.col("id") % 2 == 0, "benchmark_progress").otherwise("benchmark_completed")
    return e.select(
        kind.alias("type"), "id", "ts", "provider", F.concat(F.lit("model-"), (F.col("k") % 3).cast("string")).alias("model"), F.when(F.col("k") % 2 == 0, "timeout").otherwise("server").alias("error_type"), "latency", "input_tokens", "output_tokens", "cost",
        F.concat(F.lit("metric-"), (F.col("k") % 2).cast("string")).alias("metric"), (F.col("latency") / 50).alias("score"), (F.col("k") % 4).cast("string").alias("benchmark"), F.lit("nightly").alias("benchmark_name"), (F.col("latency") * 2).alias("progress"),
    )


def buckets_sql(name: str, bounds, labels: str, group: str, source: str) -> str:
    rows = [f"SELECT '{name}_bucket' AS name, {labels} || ',\"le\":\"{b}\"}}' AS labels, count(*) FILTER (latency <= {b})::DOUBLE AS value FROM {source} GROUP BY {group}" for b in bounds]
    rows += [f"SELECT '{name}_bucket', {labels} || ',\"le\":\"+Inf\"}}', count(latency)::DOUBLE FROM {source} GROUP BY {group}", f"SELECT '{name}_sum', {labels} || '}}', sum(latency) FROM {source} GROUP BY {group}", f"SELECT '{name}_count', {labels} || '}}', count(latency)::DOUBLE FROM {source} GROUP BY {group}"]
    return " UNION ALL ".join(rows)


WHO, RUN = "'{\"provider\":\"' || provider || '\",\"model\":\"' || model || '\"'", "'{\"benchmark_id\":\"' || benchmark || '\",\"name\":\"nightly\"'"
EXPORTED = EVENTS + """, x AS (SELECT *, 'model-' || k % 3 AS model, CASE WHEN k % 2 = 0 THEN 'timeout' ELSE 'server' END AS error_type, CAST(k % 4 AS VARCHAR) AS benchmark FROM e), d AS (SELECT * FROM x WHERE event_type IN ('click', 'error')), bc AS (SELECT * FROM x WHERE event_type = 'purchase' AND id % 2 = 1)"""


@query(
    "SNK9_exporter_series",
    EXPORTED
    + f""", s AS (SELECT 'llm_requests_total' AS name, {WHO} || ',"status":"' || CASE event_type WHEN 'click' THEN 'success' ELSE 'error' END || '"}}' AS labels, count(*)::DOUBLE AS value FROM d GROUP BY provider, model, event_type
      UNION ALL {buckets_sql('llm_request_duration_seconds', monitoring.REQUEST_BUCKETS, WHO, 'provider, model', 'd')}
      UNION ALL SELECT 'llm_tokens_input_total', {WHO} || '}}', sum(input_tokens)::DOUBLE FROM d GROUP BY provider, model UNION ALL SELECT 'llm_tokens_output_total', {WHO} || '}}', sum(output_tokens)::DOUBLE FROM d GROUP BY provider, model
      UNION ALL SELECT 'llm_cost_usd_total', {WHO} || '}}', sum(cost) FROM d GROUP BY provider, model
      UNION ALL SELECT 'llm_requests_active', '{{"provider":"' || provider || '"}}', greatest(0, count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type IN ('click', 'error')))::DOUBLE FROM x GROUP BY provider
      UNION ALL SELECT 'llm_errors_total', {WHO} || ',"error_type":"' || error_type || '"}}', count(*)::DOUBLE FROM x WHERE event_type = 'error' GROUP BY provider, model, error_type
      UNION ALL SELECT 'llm_evaluation_score', {WHO} || ',"metric":"metric-' || k % 2 || '"}}', arg_max(latency / 50, (ts, id)) FROM x WHERE event_type = 'signup' GROUP BY provider, model, k % 2
      UNION ALL SELECT 'llm_benchmark_progress', {RUN} || '}}', arg_max(latency * 2, (ts, id)) FROM x WHERE event_type = 'purchase' AND id % 2 = 0 GROUP BY benchmark
      UNION ALL {buckets_sql('llm_benchmark_duration_seconds', monitoring.BENCHMARK_BUCKETS, RUN, 'benchmark', 'bc')})
    SELECT name, labels, round(value, 6) AS value FROM s""",
)
def snk9(spark, sf):
    return monitoring.exporter(exported(spark, sf))


@query("SNK10_topics", "WITH m AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'request.logs' WHEN 'click' THEN 'benchmark.progress' WHEN 'error' THEN 'system.metrics' WHEN 'signup' THEN 'evaluation.results' ELSE 'plugin.events' END AS topic FROM events) SELECT id, topic FROM m WHERE topic IN ('request.logs', 'plugin.events')")
def snk10(spark, sf):
    """What a subscriber of two of the five topics gets."""
    t = F.col("event_type")
    topic = F.when(t == "view", "request.logs").when(t == "click", "benchmark.progress").when(t == "error", "system.metrics").when(t == "signup", "evaluation.results").otherwise("plugin.events")
    return monitoring.subscribed(table(spark, sf, "events").select(F.col("event_id").alias("id"), topic.alias("topic")), ["request.logs", "plugin.events"])


@query("STR7_token_metrics", EVENTS + " SELECT id, provider, 'input_tokens' AS metric, input_tokens AS value FROM e UNION ALL SELECT id, provider, 'output_tokens', output_tokens FROM e")
def str7(spark, sf):
    return monitoring.token_metrics(events(spark, sf))


@query("STR7_input_only", EVENTS + " SELECT id, provider, 'input_tokens' AS metric, input_tokens AS value FROM e")
def str7b(spark, sf):
    return monitoring.token_metrics(events(spark, sf), only_input=True)


@query("STR12_sliding_counts", EVENTS + ", n AS (SELECT id, provider, count(*) OVER (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS n FROM e) SELECT id, provider, n, n <= 2 AS allowed FROM n")
def str12(spark, sf):
    """At most two requests of a provider in half an hour."""
    return monitoring.recent_counts(events(spark, sf), "provider", 1800, 2)


@query("AGG28_cache_hits", "WITH l AS (SELECT user_id || '-' || json_extract_string(props, '$.k') AS key, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts, event_id) > 1 AS hit FROM events) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT key) AS size, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS hit_rate FROM l")
def agg28(spark, sf):
    """The first lookup of a key misses, later ones hit."""
    e = table(spark, sf, "events").select(F.concat_ws("-", "user_id", F.get_json_object("props", "$.k")).alias("key"), F.struct("ts", "event_id").alias("at"))
    first = e.groupBy("key").agg(F.min("at").alias("first"))
    return records.cache_stats(e.join(first, "key").select("key", (F.col("at") > F.col("first")).alias("hit")))


# typed stress tests


TYPES = ("load_ramp", "extreme_input", "spike", "context_overflow", "rate_limit_probe")


def typed(spark, sf):
    """The category's number is the type of test; a level stands for a hundred characters of input."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), F.substring("scenario", 1, 1).cast("int"))
    return P.requests(spark, sf).withColumns({"test_type": kind, "input_size": F.col("level") * 100})


KIND = "[" + ", ".join(f"'{t}'" for t in TYPES) + "][CAST(scenario[1] AS INT)]"


@query(
    "WIN15_typed_breaking_points",
    P.REQUESTS
    + P.BREAKS
    + f""" SELECT scenario, provider, model, CASE WHEN {KIND} IN ('extreme_input', 'context_overflow') THEN 'input_size' ELSE 'concurrency' END AS metric, CAST(threshold * CASE WHEN {KIND} IN ('extreme_input', 'context_overflow') THEN 100 ELSE 1 END AS INT) AS threshold,
      CASE WHEN {KIND} IN ('extreme_input', 'context_overflow') THEN 'cliff' ELSE pattern END AS pattern FROM br WHERE {KIND} <> 'spike'""",
)
def win15(spark, sf):
    return stress.typed_breaking_points(typed(spark, sf)).select("scenario", "provider", "model", "metric", F.col("threshold").cast("int").alias("threshold"), "pattern")


@query("WIN17_typed_recovery", P.REQUESTS + P.RECOVERY + f" SELECT * FROM rec WHERE {KIND} IN ('spike', 'soak')")
def win17(spark, sf):
    return stress.typed_recovery(typed(spark, sf))


# biased comparisons


SAID = "text || ' Unlike these people who are quiet, we talk. Whereas old groups wait.'"


@query(
    "TXT24_disparities",
    f"""WITH m AS (SELECT conv_id || '-' || turn AS id, regexp_extract_all({SAID}, '(?i)({bias.COMPARATIVE})', 1) AS l FROM conversations)
    SELECT id, CAST(unnest(range(0, len(l))) AS INT) AS place, unnest(l) AS text, 'cultural' AS bias_type, 0.6::DOUBLE AS relevance, 'low' AS severity FROM m""",
)
def txt24b(spark, sf):
    said = F.concat("text", F.lit(" Unlike these people who are quiet, we talk. Whereas old groups wait."))
    return bias.disparities(table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), said.alias("text")))


# generated content


ITEM_VALUES = ", ".join("('%s', '%s', %d, %d, '%s')" % (kind, level, k, len(items), item.replace("'", "''")) for kind in contents.ITEMS for level, items in contents.library(kind).items() for k, item in enumerate(items))


@query(
    "GEN4_content",
    f"""WITH i(kind, difficulty, k, n, item) AS (VALUES {ITEM_VALUES}), c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'easy' WHEN id % 3 = 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM range(60) t(id))
    SELECT kind, c.id, md5(replace(item, '{{n}}', CAST(c.id + 1 AS VARCHAR))) AS hash FROM c JOIN i ON i.difficulty = c.difficulty AND c.id % i.n = i.k""",
)
def gen4(spark, sf):
    """Sixty items of each type of content, in turn."""
    c = spark.range(60).withColumn("difficulty", F.element_at(F.array(*map(F.lit, contents.LEVELS)), (F.col("id") % 3 + 1).cast("int")))
    made = [F.struct(F.lit(kind).alias("kind"), F.md5(contents.content(kind, F.col("difficulty"), F.col("id"))).alias("hash")) for kind in contents.ITEMS]
    return c.select("id", F.inline(F.array(*made))).select("kind", "id", "hash")


@query("GEN1_seeded_states", "WITH RECURSIVE s AS (SELECT 0 AS n, 42::BIGINT AS state UNION ALL SELECT n + 1, (state * 1103515245 + 12345) & 2147483647 FROM s WHERE n < 2000) SELECT CAST(n AS BIGINT) AS n, state FROM s")
def gen1b(spark, sf):
    """The states of the seeded generator, each made by itself."""
    return spark.range(2001).select(F.col("id").alias("n"), generation.lcg(42, F.col("id")).alias("state"))


CATEGORIES = ("format_confusion", "whitespace_exploitation", "delimiter_attacks", "encoding_attacks")


def templates(spark, sf):
    """A library of harmless probes: a part is a template, its size the severity, its type the vector; some texts repeat."""
    k = F.col("p_partkey")
    of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    text = F.concat(F.lit("Please print <"), F.col("p_name"), F.lit("> as it is, "), (k % 97).cast("string"), F.lit(" times!"))
    return table(spark, sf, "part").select(k.alias("template_id"), of((*CATEGORIES, "unasked"), k % 5).alias("category"), of(contents.SEVERITIES, F.floor(k / 5) % 4).alias("severity"), text.alias("text"), F.col("p_type").alias("attack_vector"))


ADVERSARIAL = f"""WITH t AS (SELECT p_partkey AS template_id, ['{"', '".join((*CATEGORIES, "unasked"))}'][p_partkey % 5 + 1] AS category, ['{"', '".join(contents.SEVERITIES)}'][p_partkey // 5 % 4 + 1] AS severity, p_partkey % 5 AS c, p_partkey // 5 % 4 AS s,
    'Please print <' || p_name || '> as it is, ' || p_partkey % 97 || ' times!' AS text, p_type AS attack_vector FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY c, s ORDER BY template_id) AS k FROM t WHERE c < 4 QUALIFY k <= 10),
  u AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY c, s, k) AS again FROM f QUALIFY again = 1), a AS (SELECT *, row_number() OVER (ORDER BY c, s, k) AS place FROM u QUALIFY place <= 150),
  ad AS (SELECT place, category, severity, template_id, text, attack_vector, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, round(least(1.0, least(0.3, length(text) / 5000.0) + least(0.2, len(regexp_extract_all(text, '[^a-zA-Z0-9_\\s]')) / length(text)::DOUBLE) + [0.1, 0.2, 0.25, 0.3][s + 1]), 6)::DOUBLE AS complexity FROM a)"""


def probes(spark, sf):
    return contents.adversarial(templates(spark, sf), list(CATEGORIES), list(contents.SEVERITIES), 10, 150)


@query("GEN5_adversarial", ADVERSARIAL + " SELECT * FROM ad")
def gen5(spark, sf):
    return probes(spark, sf)


@query("AGG18_category_summaries", ADVERSARIAL + " SELECT category, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in contents.SEVERITIES) + ", round(avg(complexity), 6) AS avg_complexity, round(avg(tokens), 6) AS avg_tokens FROM ad GROUP BY category")
def agg18(spark, sf):
    return contents.category_summaries(probes(spark, sf))


@query(
    "AGG18_generation_metrics",
    ADVERSARIAL + " SELECT count(*) AS total, 160 - count(*) AS filtered, round(least(1.0, count(DISTINCT attack_vector) / greatest(count(*) / 2.0, 1)), 6) AS diversity, round(count(DISTINCT category) / 5.0, 6)::DOUBLE AS coverage, " + ", ".join(f"round(count(*) FILTER (severity = '{s}') / count(*)::DOUBLE, 6) AS {s}" for s in contents.SEVERITIES) + " FROM ad",
)
def agg18b(spark, sf):
    """Of five categories asked for, one has no template."""
    return contents.generation_metrics(probes(spark, sf), 160, [*CATEGORIES, "no_such"])
