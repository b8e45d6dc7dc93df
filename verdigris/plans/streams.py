"""Queries and SQL: jobs, workers and histories as state on a stream.

Events arrive up to half a day late and every tenth of them twice, in slices of a week, each of which is written after the one
before. The SQL takes what the watermark has passed at the end, in order, once.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.storage import scratch
from verdigris.plans.fixtures import table
from verdigris.streaming import monitoring, stateful, topics

Q, SQL = {}, {}
DELAY_DAYS, TIMEOUT_HOURS = 8, 12


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def happened(spark, sf):
    """A user's events are a job's actions, or a worker's heartbeats."""
    k = F.get_json_object("props", "$.k").cast("int")
    named = {"signup": F.lit("submit"), "click": F.lit("start"), "purchase": F.lit("complete"), "error": F.lit("fail")}
    action = F.coalesce(*[F.when(F.col("event_type") == t, a) for t, a in named.items()], F.when(k % 3 == 0, "cancel").when(k % 3 == 1, "retry").otherwise("view"))
    status = F.when(F.col("event_type") == "error", F.when(k % 2 == 0, "offline").otherwise("failed")).when(F.col("event_type") == "view", "idle").otherwise("busy")
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").alias("job_id"), F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), status.alias("status"))


def stream_of(spark, df, at: str, slices: int = 5):
    """``df`` as it arrives: late, partly twice, a slice of a week after the other."""
    late = F.make_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(43_200)).cast("decimal(18,6)"))
    twice = df.where("CAST(event_id AS BIGINT) % 10 = 0").select("*", (F.col("ts") + late + F.expr("INTERVAL 6 HOURS")).alias("_at"))
    arrived = df.select("*", (F.col("ts") + late).alias("_at")).unionByName(twice)
    week = F.least(F.lit(slices - 1), F.greatest(F.lit(0), F.floor(F.datediff("_at", F.lit("2024-01-01")) / 7))).cast("int")
    for k in range(slices):
        arrived.where(week == k).drop("_at").write.mode("append").parquet(f"{at}/in")
    return monitoring.read_stream(spark, f"{at}/in", df.schema, 6)


def ran(spark, make, at: str):
    """What the stream that ``make`` gives has written when all that has arrived is worked off."""
    stateful.use_rocksdb(spark)
    stream = make()
    monitoring.write_stream(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


HAPPENED = f"""WITH RECURSIVE k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), h AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, epoch_us(ts) // 1000 AS ms,
    CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE CASE k % 3 WHEN 0 THEN 'cancel' WHEN 1 THEN 'retry' ELSE 'view' END END AS action,
    CASE event_type WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'offline' ELSE 'failed' END WHEN 'view' THEN 'idle' ELSE 'busy' END AS status
  FROM k), mark AS (SELECT max(ms) - {DELAY_DAYS} * 86400000 AS mark FROM h), p AS (SELECT h.*, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM h, mark WHERE ms <= mark)"""
AFTER = """CASE WHEN status = '' AND action = 'submit' THEN 'pending' WHEN status = 'pending' AND action = 'start' THEN 'running' WHEN status = 'running' AND action = 'complete' THEN 'completed'
    WHEN status = 'running' AND action = 'fail' THEN 'failed' WHEN status IN ('pending', 'running') AND action = 'cancel' THEN 'cancelled' WHEN status = 'failed' AND action = 'retry' AND retries < 3 THEN 'pending' ELSE status END"""


@query(
    "STR9_job_states",
    HAPPENED
    + f""", s AS (SELECT user_id, n, event_id, ms, action, '' AS before, CASE WHEN action = 'submit' THEN 'pending' ELSE '' END AS status, 0 AS retries FROM p WHERE n = 1
      UNION ALL SELECT user_id, n, event_id, ms, action, status, {AFTER}, retries + CASE WHEN status = 'failed' AND action = 'retry' AND retries < 3 THEN 1 ELSE 0 END
      FROM (SELECT s.user_id, p.n, p.event_id, p.ms, p.action, s.status, s.retries FROM s JOIN p ON p.user_id = s.user_id AND p.n = s.n + 1))
    SELECT user_id AS job_id, event_id, action, before, status AS after, CAST(retries AS INT) AS retries, before <> status AS accepted FROM s""",
)
def str9_states(spark, sf):
    """The log of every job's actions, refused ones among them."""
    at = scratch(spark)
    stream_in = stream_of(spark, happened(spark, sf).select("event_id", "job_id", "ts", "action"), at)
    return ran(spark, lambda: stateful.job_transitions(stream_in, f"{DELAY_DAYS} days"), at).drop("ts")


@query("STR9_job_states_table", SQL["STR9_job_states"].replace(" WHERE ms <= mark", ""))
def str9_table(spark, sf):
    """The same over the whole table, hot jobs split over ranges of time."""
    return stateful.job_transitions(happened(spark, sf)).drop("ts")


CHANGES = f""", w AS (SELECT *, status IN ('idle', 'busy') AS well, lag(status IN ('idle', 'busy')) OVER o AS was, ms - lag(ms) OVER o AS gap, coalesce(lead(ms) OVER o, mark) AS next FROM p, mark WINDOW o AS (PARTITION BY user_id ORDER BY ms, event_id)),
    c AS (SELECT user_id, ms, 'joined' AS change FROM w WHERE well AND (was IS NULL OR NOT was OR gap >= {TIMEOUT_HOURS} * 3600000)
      UNION ALL SELECT user_id, ms, 'failed' FROM w WHERE NOT well AND was AND gap < {TIMEOUT_HOURS} * 3600000
      UNION ALL SELECT user_id, ms + {TIMEOUT_HOURS} * 3600000, 'failed' FROM w WHERE well AND next - ms >= {TIMEOUT_HOURS} * 3600000)"""


@query("STR11_worker_changes", HAPPENED + CHANGES + " SELECT user_id AS worker_id, ms AS at_ms, change FROM c")
def str11_changes(spark, sf):
    """Workers join and fail; silence is judged as the watermark goes on."""
    at = scratch(spark)
    stream_in = stream_of(spark, happened(spark, sf).select("event_id", "worker_id", "ts", "status"), at)
    out = ran(spark, lambda: stateful.worker_changes(stream_in, f"{DELAY_DAYS} days", TIMEOUT_HOURS * 3_600_000), at)
    return out.select("worker_id", F.unix_millis("ts").alias("at_ms"), "change")


@query(
    "STR10_stream_history",
    HAPPENED + " SELECT event_id AS job_id, CAST(row_number() OVER (ORDER BY ms DESC, event_id DESC) AS INT) AS place FROM h WHERE action = 'complete' QUALIFY row_number() OVER (ORDER BY ms DESC, event_id DESC) <= 1000",
)
def str10_history(spark, sf):
    """Completed jobs, the latest thousand of which are kept as they come."""
    at = scratch(spark)
    ended = happened(spark, sf).where("action = 'complete'").select("event_id", F.col("event_id").alias("job_id"), "ts")
    stream_in = stream_of(spark, ended, at)
    return stateful.latest_of(ran(spark, lambda: stateful.completed_history(stream_in), at)).select("job_id", F.col("place").cast("int").alias("place"))


TOPIC = {"signup": "benchmark.progress", "click": "evaluation.results", "purchase": "system.metrics", "error": "plugin.events", "view": "request.logs"}
TOPICS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOPIC.items()) + " END"


@query(
    "SNK10_topic_bus",
    f"SELECT event_id AS id, {TOPICS_SQL} AS topic FROM events WHERE event_type IN ('error', 'view') UNION ALL SELECT event_id, {TOPICS_SQL} FROM events WHERE event_type IN ('error', 'view') AND event_id % 10 = 0",
)
def snk10_bus(spark, sf):
    """What a stream publishes to the bus, as a subscriber of two topics receives it."""
    at = scratch(spark)
    topic = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in TOPIC.items()])
    sent = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), topic.alias("topic"))
    topics.publish(stream_of(spark, sent, at).drop("ts"), f"{at}/bus", f"{at}/publisher")
    stream = topics.subscribe(spark, f"{at}/bus", "event_id long", ["request.logs", "plugin.events"], 8)
    monitoring.write_stream(stream, f"{at}/out", f"{at}/subscriber").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(F.col("event_id").alias("id"), "topic")
