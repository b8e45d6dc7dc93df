"""Monitoring of request events: the same functions work on a stream and on a table.

An event has: id, event_type, ts, provider, latency, input_tokens, output_tokens, cost. On a stream,
events later than ``RETENTION`` behind the latest one are dropped by the watermark; a table keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RETENTION = "1 hour"
#: Upper bounds of latency buckets, in seconds; the last two are for exports.
BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 30.0, 60.0)


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A file source: whatever Parquet file appears under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def retained(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """On a stream: the watermark. On a table: what is younger than an hour before ``as_of``."""
    if events.isStreaming:
        return events.withWatermark("ts", RETENTION)
    return events if as_of is None else events.where(F.col("ts") > as_of - F.expr(f"interval {RETENTION}"))


def measures() -> list[Column]:
    error = F.col("event_type") == "error"
    return [
        F.count("*").alias("requests"), F.count_if(error).alias("errors"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost"), 6).alias("cost"), F.round(F.avg("latency"), 9).alias("avg_latency"), F.max("latency").alias("max_latency"),
    ]


def provider_stats(events: DataFrame) -> DataFrame:
    """Per provider, the mean latency over all its events that have one."""
    return events.groupBy("provider").agg(*measures())


def latest(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Latest, mean and sum of a series; of equal times the larger id is the later."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct("ts", "id")).alias("latest"), F.round(F.avg(value), 6).alias("average"), F.round(F.sum(value), 6).alias("total"))


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return retained(events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(*measures()).select(F.col("w.start").alias("start"), "event_type", "requests", "errors", "avg_latency")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return retained(events).groupBy(F.window("ts", width, step).alias("w")).agg(*measures()).select(F.col("w.start").alias("start"), "requests", "errors", "avg_latency")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return retained(events).groupBy(F.session_window("ts", gap).alias("w"), "provider").agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "provider", "requests")


def histogram(events: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts of latencies up to each bound, as exporters name them (le), and sum and count."""
    counts = [F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col("latency") <= b).alias("n")) for b in BUCKETS] + [F.struct(F.lit("+Inf").alias("le"), F.count("latency").alias("n"))]
    return events.groupBy(*keys).agg(F.array(*counts).alias("b")).select(*keys, F.inline("b"))


def counters(events: DataFrame) -> DataFrame:
    """(name, provider, value): the series that an exporter serves."""
    s = provider_stats(events)
    names = {"requests_total": "requests", "errors_total": "errors", "input_tokens_total": "input_tokens", "output_tokens_total": "output_tokens", "cost_total": "cost"}
    return s.select("provider", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in names.items()]))).select("name", "provider", F.round("value", 6).alias("value"))


#: Upper bounds of the exporter's histograms, in seconds.
REQUEST_BUCKETS, BENCHMARK_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0), (1.0, 5.0, 10.0, 30.0, 60.0, 300.0, 600.0, 1800.0)


def exporter(events: DataFrame) -> DataFrame:
    """(name, labels, value): the ten series that an exporter serves, from events: type (request_started, request_completed,
    request_failed, evaluation, benchmark_progress, benchmark_completed), id, ts, provider, model, error_type, latency (s),
    input_tokens, output_tokens, cost, metric, score, benchmark, benchmark_name, progress. ``labels`` is JSON."""
    kind = lambda *types: F.col("type").isin(*types)
    label = lambda **l: F.to_json(F.struct(*[c.alias(n) for n, c in l.items()]))
    c, who = F.col, {"provider": F.col("provider"), "model": F.col("model")}
    series = lambda name, labels, value: F.struct(F.lit(name).alias("name"), labels.alias("labels"), value.cast("double").alias("value"))

    def buckets(of: str, value: str, bounds: tuple[float, ...], **labels: Column) -> list[Column]:
        out = [series(f"{of}_bucket", label(**labels, le=F.lit(str(b))), c(f"{value}_{k}")) for k, b in enumerate(bounds)]
        return [*out, series(f"{of}_bucket", label(**labels, le=F.lit("+Inf")), c("n")), series(f"{of}_sum", label(**labels), c("total")), series(f"{of}_count", label(**labels), c("n"))]

    counted = lambda value, bounds: [F.count_if(c(value) <= b).alias(f"{value}_{k}") for k, b in enumerate(bounds)] + [F.count(value).alias("n"), F.sum(value).alias("total")]
    ended = events.where(kind("request_completed", "request_failed"))
    status = F.when(kind("request_completed"), "success").otherwise("error")
    by_status = ended.groupBy("provider", "model", status.alias("status")).agg(F.count("*").alias("n")).select(F.inline(F.array(series("llm_requests_total", label(**who, status=c("status")), c("n")))))
    measured = ended.groupBy("provider", "model").agg(*counted("latency", REQUEST_BUCKETS), *[F.sum(x).alias(x) for x in ("input_tokens", "output_tokens", "cost")])
    of_model = measured.select(F.inline(F.array(
        *buckets("llm_request_duration_seconds", "latency", REQUEST_BUCKETS, **who), series("llm_tokens_input_total", label(**who), c("input_tokens")),
        series("llm_tokens_output_total", label(**who), c("output_tokens")), series("llm_cost_usd_total", label(**who), c("cost")),
    )))
    active = events.groupBy("provider").agg((F.count_if(kind("request_started")) - F.count_if(kind("request_completed", "request_failed"))).alias("n")).select(
        F.inline(F.array(series("llm_requests_active", label(provider=c("provider")), F.greatest(F.lit(0), c("n")))))
    )
    errors = events.where(kind("request_failed")).groupBy("provider", "model", "error_type").agg(F.count("*").alias("n")).select(F.inline(F.array(series("llm_errors_total", label(**who, error_type=c("error_type")), c("n")))))
    last = lambda value: F.max_by(value, F.struct("ts", "id")).alias("v")
    scores = events.where(kind("evaluation")).groupBy("provider", "model", "metric").agg(last("score")).select(F.inline(F.array(series("llm_evaluation_score", label(**who, metric=c("metric")), c("v")))))
    run = {"benchmark_id": c("benchmark"), "name": c("benchmark_name")}
    progress = events.where(kind("benchmark_progress")).groupBy("benchmark", "benchmark_name").agg(last("progress")).select(F.inline(F.array(series("llm_benchmark_progress", label(**run), c("v")))))
    took = events.where(kind("benchmark_completed")).groupBy("benchmark", "benchmark_name").agg(*counted("latency", BENCHMARK_BUCKETS)).select(F.inline(F.array(*buckets("llm_benchmark_duration_seconds", "latency", BENCHMARK_BUCKETS, **run))))
    out = by_status
    for more in (of_model, active, errors, scores, progress, took):
        out = out.unionByName(more)
    return out.withColumn("value", F.round("value", 6))


#: Topics that subscribers choose.
TOPICS = ("benchmark.progress", "evaluation.results", "system.metrics", "plugin.events", "request.logs")


def subscribed(messages: DataFrame, topics: list[str]) -> DataFrame:
    """Messages (topic ...) of the chosen topics, on a stream or a table; a topic that there is not is an error."""
    if unknown := set(topics) - set(TOPICS):
        raise ValueError(f"unknown topics: {sorted(unknown)}")
    return messages.where(F.col("topic").isin(*topics))


def token_metrics(events: DataFrame, only_input: bool = False) -> DataFrame:
    """(id, provider, metric, value): a tokens event gives a metric of the input tokens and one of the output tokens.
    With ``only_input`` just the first, which is all that some publishers send."""
    both = [F.struct(F.lit(f"{k}_tokens").alias("metric"), F.col(f"{k}_tokens").alias("value")) for k in ("input", "output")]
    return events.select("id", "provider", F.inline(F.array(*both[: 1 if only_input else 2])))


def recent_counts(events: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """What a sliding window of a limiter sees: for each event, how many of its key came in the ``seconds`` up to it, itself
    and equal times included, and whether that is within ``limit``. Events are sorted hour by hour (or window by window,
    if that is longer), those at an hour's end once more before the next, so a hot key is many tasks' work."""
    long = max(3600, seconds)
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = F.floor(second / (long * 1_000_000)).cast("long")
    at = events.select("id", key, second.alias("_at"), hour.alias("_hour"))
    again = at.where(F.col("_at") >= (F.col("_hour") + 1) * long * 1_000_000 - seconds * 1_000_000)
    both = at.withColumn("_own", F.lit(True)).unionByName(again.withColumns({"_hour": F.col("_hour") + 1, "_own": F.lit(False)}))
    window = Window.partitionBy(key, "_hour").orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    n = F.count("*").over(window)
    return both.withColumn("n", n).where("_own").select("id", key, "n", (F.col("n") <= limit).alias("allowed"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs what is there now to the end, then stops; results are Parquet files."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(df: DataFrame, handle, checkpoint: str, mode: str = "update"):
    """Hands each micro-batch to ``handle(batch, number)``: subscribers, web sockets, upserts."""
    return df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alive(workers: DataFrame, as_of: Column, timeout_s: int) -> DataFrame:
    """Workers heard of less than ``timeout_s`` ago and idle or busy are alive; others are stale."""
    silent = F.unix_timestamp(as_of) - F.unix_timestamp("heartbeat")
    return workers.withColumn("alive", (silent < timeout_s) & F.col("status").isin("idle", "busy"))
