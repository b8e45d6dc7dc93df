"""Queries and SQL: record store, cluster, monitoring, generation, sources and sinks, filters, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import similarity as S
from verdigris.functions.storage import scratch
from verdigris.operators import benchmark, generation, records
from verdigris.plans.fixtures import MODELS, RESULTS, model_results, results, table
from verdigris.sources import files
from verdigris.streaming import monitoring

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


AS_OF = "2001-01-01"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def jobs(spark, sf):
    """An order is a job."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderkey") % 7 == 0, "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("pending")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_totalprice").alias("budget"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"),
    )


JOBS = """WITH j AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'pending' END AS status,
  6 - CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at, o_totalprice AS budget, CAST(o_orderkey % 5 AS INT) AS attempts FROM orders)"""


def workers(spark, sf):
    """A supplier is a worker."""
    k = F.col("s_suppkey")
    status = F.when(k % 4 == 0, "busy").when(k % 9 == 0, "offline").otherwise("idle")
    return table(spark, sf, "supplier").select(
        k.alias("id"), status.alias("status"), (k % 6).cast("int").alias("capacity"), F.least(k % 3, k % 6).cast("int").alias("tasks"),
        F.when(k % 2 == 0, F.array(F.lit("gpu"), F.lit("eu"))).otherwise(F.array(F.lit("eu"))).alias("tags"), (as_of() - F.make_interval(secs=(k % 100).cast("decimal(18,6)"))).alias("heartbeat"),
    )


WORKERS = """WITH w AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'busy' WHEN s_suppkey % 9 = 0 THEN 'offline' ELSE 'idle' END AS status, CAST(s_suppkey % 6 AS INT) AS capacity,
  CAST(least(s_suppkey % 3, s_suppkey % 6) AS INT) AS tasks, s_suppkey % 2 = 0 AS gpu, s_suppkey % 100 AS silent FROM supplier)"""


@query("DML1_insert", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS s FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT 1000000000 + c_custkey FROM customer)")
def dml1(spark, sf):
    new = table(spark, sf, "customer").select((F.col("c_custkey") + 1_000_000_000).alias("id"), F.lit("pending").alias("status"))
    return records.insert(jobs(spark, sf).select("id", "status"), new).agg(F.count("*").alias("n"), F.sum("id").alias("s"))


@query("DML2_partial_update", JOBS + " SELECT id, CASE WHEN id % 10 = 0 THEN 'cancelled' ELSE status END AS status, priority, (id % 10 = 0) AS touched FROM j")
def dml2(spark, sf):
    j = jobs(spark, sf).select("id", "status", "priority", "updated_at")
    changes = j.where("id % 10 = 0").select("id", F.lit("cancelled").alias("status"), F.lit(None).cast("int").alias("priority"))
    return records.update(j, changes, as_of() + F.make_interval(years=F.lit(100))).select("id", "status", "priority", (F.col("updated_at") == as_of() + F.make_interval(years=F.lit(100))).alias("touched"))


@query("DML3_cleanup", JOBS + f" SELECT id, status FROM j WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY)")
def dml3(spark, sf):
    return records.cleanup(jobs(spark, sf), as_of(), 365).select("id", "status")


@query("DML3_delete", JOBS + " SELECT id, status FROM j WHERE id % 3 <> 0")
def dml3b(spark, sf):
    j = jobs(spark, sf)
    return records.delete(j, j.where("id % 3 = 0")).select("id", "status")


@query("DML4_point_lookup", JOBS + " SELECT id, status, priority FROM j WHERE id = 7")
def dml4(spark, sf):
    return jobs(spark, sf).where("id = 7").select("id", "status", "priority")


@query("DML5_count", JOBS + " SELECT count(*) AS n FROM j WHERE status = 'failed'")
def dml5(spark, sf):
    return jobs(spark, sf).where("status = 'failed'").agg(F.count("*").alias("n"))


@query("AGG21_job_status", JOBS + " SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "running", "completed", "failed")) + " FROM j")
def agg21(spark, sf):
    return records.status_counts(jobs(spark, sf))


@query("WIN20_priority_queue", JOBS + " SELECT id, priority FROM j WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 100")
def win20(spark, sf):
    return records.next_jobs(jobs(spark, sf), 100).select("id", "priority")


@query("WIN21_least_loaded", WORKERS + " SELECT id, round(CASE WHEN capacity = 0 THEN 1.0 ELSE tasks / capacity::DOUBLE END, 6) AS load FROM w WHERE status = 'idle' AND gpu ORDER BY load, id LIMIT 1")
def win21(spark, sf):
    return records.least_loaded(workers(spark, sf), ["gpu", "eu"])


@query("WIN22_page", JOBS + " SELECT id FROM j ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def win22(spark, sf):
    return records.page(jobs(spark, sf), 3, 20, F.desc("created_at"), "id").select("id")


@query("WIN23_recent_per_user", JOBS + " SELECT user_id, id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM j) WHERE place <= 3")
def win23(spark, sf):
    return records.latest_per(jobs(spark, sf), "user_id", 3, F.desc("created_at"), "id").select("user_id", "id", "place")


@query("STR10_completed_history", JOBS + " SELECT id FROM j WHERE status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 1000")
def str10(spark, sf):
    return records.recent_history(jobs(spark, sf), 1000).select("id")


@query("STR9_retry_candidates", JOBS + " SELECT id, attempts FROM j WHERE status = 'failed' AND attempts < 3")
def str9(spark, sf):
    return records.retry_candidates(jobs(spark, sf), 3).select("id", "attempts")


@query("STR11_liveness", WORKERS + " SELECT id, silent < 60 AND status IN ('idle', 'busy') AS alive FROM w")
def str11(spark, sf):
    return monitoring.alive(workers(spark, sf), as_of(), 60).select("id", "alive")


@query("FLT6_worker_tags", WORKERS + " SELECT id, status FROM w WHERE gpu")
def flt6(spark, sf):
    return records.with_tags(workers(spark, sf), ["gpu", "eu"]).select("id", "status")


@query("DT1_as_of_window", JOBS + f" SELECT id FROM j WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND created_at < TIMESTAMP '{AS_OF}'")
def dt1(spark, sf):
    return jobs(spark, sf).where((F.col("created_at") >= as_of() - F.make_interval(days=F.lit(30))) & (F.col("created_at") < as_of())).select("id")


@query("DT2_formats", JOBS + " SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS minute, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339 FROM j")
def dt2(spark, sf):
    return jobs(spark, sf).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("minute"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rfc3339"))


@query("DT3_cache_ttl", JOBS + f" SELECT id FROM j WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR")
def dt3(spark, sf):
    return records.fresh(jobs(spark, sf), as_of()).select("id")


# monitoring


def events(spark, sf):
    """User groups are providers; values are latencies, costs and tokens."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "event_type", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("provider-"), (F.col("user_id") % 5).cast("string")).alias("provider"),
        (F.col("value") / 10).alias("latency"), F.floor("value").cast("long").alias("input_tokens"), F.floor(F.col("value") / 2).cast("long").alias("output_tokens"), (F.col("value") / 1000).alias("cost"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EVENTS = """WITH e AS (SELECT event_id AS id, event_type, ts, 'provider-' || user_id % 5 AS provider, value / 10 AS latency, CAST(floor(value) AS BIGINT) AS input_tokens, CAST(floor(value / 2) AS BIGINT) AS output_tokens, value / 1000 AS cost,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
STATS = "count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 6) AS cost, round(avg(latency), 9) AS avg_latency, max(latency) AS max_latency"


@query("STR3_provider_stats", EVENTS + f" SELECT provider, {STATS} FROM e GROUP BY provider")
def str3(spark, sf):
    return monitoring.provider_stats(events(spark, sf))


@query("STR2_series_latest", EVENTS + " SELECT provider, event_type, arg_max(latency, (ts, id)) AS latest, round(avg(latency), 6) AS average, round(sum(latency), 6) AS total FROM e GROUP BY ALL")
def str2(spark, sf):
    return monitoring.latest(events(spark, sf), ["provider", "event_type"], "latency")


@query("STR4_retention", EVENTS + " SELECT id FROM e WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 HOUR")
def str4(spark, sf):
    return monitoring.retained(events(spark, sf), F.lit("2024-01-15 12:00:00").cast("timestamp")).select("id")


@query(
    "STR5_histogram",
    EVENTS + " SELECT provider, " + "b.le, count(*) FILTER (b.le = '+Inf' OR latency <= TRY_CAST(b.le AS DOUBLE)) AS n FROM e, (VALUES " + ", ".join(f"('{b}')" for b in monitoring.BUCKETS) + ", ('+Inf')) b(le) GROUP BY ALL",
)
def str5(spark, sf):
    return monitoring.histogram(events(spark, sf), ["provider"])


@query(
    "STR6_counters",
    EVENTS
    + f", s AS (SELECT provider, {STATS} FROM e GROUP BY provider) SELECT unnest(['requests_total', 'errors_total', 'input_tokens_total', 'output_tokens_total', 'cost_total']) AS name, provider, round(unnest([requests::DOUBLE, errors::DOUBLE, input_tokens::DOUBLE, output_tokens::DOUBLE, cost]), 6) AS value FROM s",
)
def str6(spark, sf):
    return monitoring.counters(events(spark, sf))


@query("STR8_progress", JOBS + " SELECT user_id, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (status = 'completed') * 100.0 / count(*) ELSE 0 END, 6) AS progress FROM j GROUP BY user_id")
def str8(spark, sf):
    return jobs(spark, sf).groupBy("user_id").agg(F.round(benchmark.ratio(F.count_if(F.col("status") == "completed") * 100.0, F.count("*")), 6).alias("progress"))


@query("STR13_tumbling", EVENTS + " SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(latency), 9) AS avg_latency FROM e GROUP BY ALL")
def str13(spark, sf):
    return monitoring.tumbling(events(spark, sf), "1 hour").withColumn("start", F.to_timestamp_ntz(F.col("start").cast("string")))


@query(
    "STR13_sliding",
    EVENTS
    + """, w AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS start FROM e, range(2) t(o)) SELECT start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(latency), 9) AS avg_latency FROM w GROUP BY start""",
)
def str13b(spark, sf):
    return monitoring.sliding(events(spark, sf), "1 hour", "30 minutes").withColumns({"start": F.to_timestamp_ntz(F.col("start").cast("string"))})


@query(
    "STR13_sessions",
    EVENTS
    + """, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 15 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY provider ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY provider ORDER BY ts RANGE UNBOUNDED PRECEDING) AS sess FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 15 MINUTE AS "end", provider, count(*) AS requests FROM s GROUP BY provider, sess""",
)
def str13c(spark, sf):
    return monitoring.sessions(events(spark, sf), "15 minutes").withColumns({c: F.to_timestamp_ntz(F.col(c).cast("string")) for c in ("start", "end")})


# generation


@query("GEN1_cases")
def gen1(spark, sf):
    return generation.cases(spark, 1000, 7)


@query("GEN3_progressive", "SELECT id, CASE WHEN id / 1000.0 < 0.33 THEN 'easy' WHEN id / 1000.0 < 0.66 THEN 'medium' ELSE 'hard' END AS difficulty FROM range(1000) t(id)")
def gen3(spark, sf):
    return generation.cases(spark, 1000, 7, "progressive").select("id", "difficulty")


@query("AGG17_generation_quality")
def agg17(spark, sf):
    return generation.quality(generation.cases(spark, 1000, 7))


@query("GEN6_sample")
def gen6(spark, sf):
    return generation.sampled(results(spark, sf), 0.1, 7, "test_id").select("test_id", "status")


KINDS = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in generation.CHARACTERS.items())


@query(
    "GEN7_extreme_inputs",
    f"""WITH k(kind, letters) AS (VALUES {KINDS}), z AS (SELECT s AS size, kind, letters, CASE kind WHEN 'emoji' THEN s // 2 ELSE s END AS n FROM k, (VALUES (0), (1), (7), (1000), (100000)) t(s))
    SELECT size, kind, CAST(n AS INT) AS characters, md5(substring(repeat(letters, CAST(ceil(n / length(letters)::DOUBLE) AS BIGINT)), 1, n)) AS hash FROM z""",
)
def gen7(spark, sf):
    made = spark.range(1).select(F.inline(generation.extreme([0, 1, 7, 1000, 100_000])))
    return made.select("size", "kind", F.char_length("text").alias("characters"), F.md5("text").alias("hash"))


@query("FLT7_constraints", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 100 AND 5000 AND NOT contains(lower(text), 'license') AND NOT contains(lower(text), 'idiot')")
def flt7(spark, sf):
    return generation.constrained(table(spark, sf, "documents"), 100, 5000, ["License", "idiot"]).select("doc_id")


VARIANTS = {
    "paraphrase": [f"'{lead}' || lower(text[1]) || substring(text, 2)" for lead in ("Please ", "Could you ", "I would like you to ")],
    "instruction_rephrase": ["text", "text || chr(10) || chr(10) || 'Please be specific.'", "'Task: ' || text"],
    "format_change": ["text", "'# Request' || chr(10) || chr(10) || text", "'Question: ' || text || chr(10) || chr(10) || 'Answer:'"],
    "tone_shift": ["text", "'Formally speaking, ' || text", "'Hey, ' || lower(text)"],
    "detail_expansion": ["text", "text || ' Please provide a detailed explanation.'", "text || ' Be comprehensive in your response.'"],
    "emphasis_change": ["text", "'IMPORTANT: ' || text", "text || ' (This is critical)'"],
    "detail_reduction": ["CASE WHEN regexp_matches(text, '[.!?]') THEN regexp_split_to_array(text, '[.!?]+')[1] || '.' ELSE text END", "text", "text"],
    "order_change": ["CASE WHEN regexp_matches(text, '[.!?]') THEN trim(array_to_string(list_reverse(regexp_extract_all(text, '[.!?]+|[^.!?]+')), '')) ELSE text END", "text", "text"],
}


@query(
    "TXT28_perturbations",
    "WITH p AS (SELECT conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'user') " + " UNION ALL ".join(f"SELECT id, '{kind}' AS kind, {i} AS index, md5({sql}) AS prompt_hash FROM p" for kind, v in VARIANTS.items() for i, sql in enumerate(v)),
)
def txt28(spark, sf):
    prompts = table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return generation.perturbed(prompts).select("id", "kind", "index", F.md5("prompt").alias("prompt_hash"))


# joins, filters, sinks


@query("AGG26_mean_score", f"WITH {MODELS} SELECT model, round(coalesce(list_avg(list_filter([faithfulness, relevance, coherence], lambda x: x IS NOT NULL)), 0.0), 6) AS score FROM m")
def agg26(spark, sf):
    scores = F.map_filter(F.create_map(*[x for n in ("faithfulness", "relevance", "coherence") for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull())
    values = F.map_values("scores")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return model_results(spark, sf).select("model", scores.alias("scores")).select("model", F.round(F.when(F.size("scores") == 0, 0.0).otherwise(mean), 6).alias("score"))


@query(
    "JN2_baseline_candidate",
    f"""WITH {RESULTS}, b AS (SELECT provider, model, avg(duration_ms) AS base FROM r WHERE ts < TIMESTAMP '1998-07-01' GROUP BY ALL), c AS (SELECT provider, model, avg(duration_ms) AS cand FROM r WHERE ts >= TIMESTAMP '1998-07-01' GROUP BY ALL)
    SELECT provider, model, round(base, 6) AS base, round(cand, 6) AS cand FROM b JOIN c USING (provider, model) WHERE provider IN ('A', 'R')""",
)
def jn2(spark, sf):
    r = results(spark, sf).withColumn("old", F.col("ts") < F.lit("1998-07-01").cast("timestamp"))
    side = lambda old, name: r.where(F.col("old") == old).groupBy("provider", "model").agg(F.round(F.avg("duration_ms"), 6).alias(name))
    wanted = spark.createDataFrame([("A",), ("R",)], "provider string")
    return side(True, "base").join(side(False, "cand"), ["provider", "model"]).join(F.broadcast(wanted), "provider", "left_semi")


@query("JN11_cartesian_plan", "SELECT n_name AS repo_id, p AS provider, s AS scenario, CAST(i AS INT) AS iteration FROM nation, (VALUES ('A'), ('N')) a(p), (VALUES ('load'), ('spike')) b(s), range(1, 4) c(i)")
def jn11(spark, sf):
    """Repositories x providers x scenarios x iterations: all but the first are stated lists."""
    lists = F.inline(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(s).alias("scenario")) for p in ("A", "N") for s in ("load", "spike")]))
    plan = table(spark, sf, "nation").select(F.col("n_name").alias("repo_id"), lists)
    return plan.select("repo_id", "provider", "scenario", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("iteration"))


@query("JN13_configured_providers", f"WITH {RESULTS} SELECT provider, model, count(*) AS n FROM r WHERE (provider, model) IN (VALUES ('A', 'model-1'), ('N', 'model-2'), ('Z', 'none')) GROUP BY ALL")
def jn13(spark, sf):
    wanted = spark.createDataFrame([("A", "model-1"), ("N", "model-2"), ("Z", "none")], "provider string, model string")
    return results(spark, sf).join(F.broadcast(wanted), ["provider", "model"]).groupBy("provider", "model").agg(F.count("*").alias("n"))


@query(
    "SNK3_result_csv",
    f"""WITH {RESULTS} SELECT test_id, category, status, CAST(duration_ms AS VARCHAR) AS duration_ms, coalesce(CAST(tokens AS VARCHAR), '') AS tokens, CASE WHEN cost IS NULL THEN '' ELSE printf('%.6f', cost) END AS cost, model, '' AS prompt_length,
      '' AS response_length, coalesce(CAST(prompt_tokens AS VARCHAR), '') AS prompt_tokens, coalesce(CAST(completion_tokens AS VARCHAR), '') AS completion_tokens, '' AS finish_reason, '' AS error, '' AS timestamp FROM rc""",
)
def snk3(spark, sf):
    return files.export_view(results(spark, sf).withColumns({"tokens": benchmark.tokens(), "cost": benchmark.cost()}))


@query(
    "SNK4_fleet_csv",
    f"""WITH {RESULTS} SELECT provider, CAST(count(*) AS VARCHAR) AS total, printf('%.4f', count(*) FILTER (status = 'success') / count(*)::DOUBLE) AS success_rate, printf('%.2f', avg(duration_ms)) AS avg_duration_ms, printf('%.6f', coalesce(sum(cost), 0)) AS total_cost
      FROM rc GROUP BY provider""",
)
def snk4(spark, sf):
    b = benchmark.breakdown(results(spark, sf), "provider")
    f = lambda spec, c: F.format_string(spec, F.col(c))
    return b.orderBy("provider").select("provider", F.col("total").cast("string").alias("total"), f("%.4f", "success_rate").alias("success_rate"), f("%.2f", "avg_duration_ms").alias("avg_duration_ms"), f("%.6f", "total_cost").alias("total_cost"))


@query("SNK6_ordered_json", f"WITH {RESULTS} SELECT '{{\"n\":' || count(*) || ',\"status\":\"' || status || '\"}}' AS json FROM r GROUP BY status")
def snk6(spark, sf):
    return files.ordered_json(results(spark, sf).groupBy("status").agg(F.count("*").alias("n")), "status")


@query("SRC7_provider_spec", "SELECT DISTINCT split_part(s, ':', 1) AS provider, CASE WHEN contains(s, ':') THEN substring(s, strpos(s, ':') + 1) ELSE '' END AS model FROM (SELECT CASE p_size % 3 WHEN 0 THEN p_brand ELSE p_brand || ':' || p_type || ':x' END AS s FROM part)")
def src7(spark, sf):
    spec = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.concat_ws(":", "p_brand", "p_type", F.lit("x")))
    part = F.split(spec, ":", 2)
    return table(spark, sf, "part").select(part[0].alias("provider"), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("")).alias("model")).distinct()


@query("SRC10_decisions_by_agent", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' AND event_id % 2 = 0 UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id = 7")
def src10(spark, sf):
    """Persisted decisions: one agent's, as its files have them, and one by its id."""
    at = f"{scratch(spark)}/decisions"
    d = table(spark, sf, "events").where("event_id % 2 = 0 OR event_id = 7").select(F.col("event_id").alias("id"), F.col("event_type").alias("agent_id"), "value")
    files.persist_decisions(d, at)
    found = files.decisions(spark, at, "error").where("id % 2 = 0").unionByName(files.decision(spark, at, 7))
    return found.select(F.col("id").alias("event_id"), F.col("agent_id").alias("event_type"), "value")


@query("SET3_keyword_sets", "SELECT c_custkey, CAST(len(list_intersect(a, b)) AS INT) AS common, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS either FROM (SELECT c_custkey, list_distinct(string_split(lower(c_mktsegment), '')) AS a, list_distinct(string_split(lower(c_name), '')) AS b FROM customer)")
def set3(spark, sf):
    a, b = F.split(F.lower("c_mktsegment"), ""), F.split(F.lower("c_name"), "")
    return table(spark, sf, "customer").select("c_custkey", F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("either"))


@query("MTH8_backoff", "SELECT CAST(a AS INT) AS attempt, CAST(least(60000, 1000 * power(2, a)) AS BIGINT) AS wait_ms FROM range(10) t(a)")
def mth8(spark, sf):
    return spark.range(10).select(F.col("id").cast("int").alias("attempt"), F.least(F.lit(60000), F.lit(1000) * F.pow(F.lit(2), F.col("id"))).cast("long").alias("wait_ms"))


@query("WIN25_most_similar", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 10")
def win25(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    one = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return v.where("vec_id != 0").join(one).select("vec_id", F.round(S.cosine(F.col("q"), F.col("embedding")), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(10)
