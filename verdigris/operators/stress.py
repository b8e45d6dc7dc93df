"""Stress tests: failure modes, scenario statistics, breaking points, recovery, robustness.

A request row has: scenario, provider, model, level, success, failure_mode, latency_ms, ts, tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.percentiles import with_percentiles
from verdigris.functions.storage import checkpoint, stored

SCENARIO = ["scenario", "provider", "model"]
#: What is found of scenarios is broadcast up to so many of them.
MOST_SCENARIOS = 10_000


def failure_modes(requests: DataFrame) -> DataFrame:
    """Per scenario and mode: count, share of the scenario's failures, first time."""
    modes = requests.where(~F.col("success")).groupBy("scenario", F.coalesce("failure_mode", F.lit("unknown")).alias("mode")).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"))
    return modes.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("scenario")), 6))


def scenario_stats(requests: DataFrame, most_latency: float, least_success: float) -> DataFrame:
    """Counts, latency over successes, percentiles by nearest rank, and whether thresholds are kept."""
    ok = F.col("success")
    base = requests.groupBy(*SCENARIO).agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("succeeded"), F.round(F.count_if(ok) / F.count("*"), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("latency_ms"))), F.lit(0.0)), 6).alias("latency_mean"),
    )
    out = with_percentiles(base, requests.where(ok), SCENARIO, "latency_ms", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95), "p99": ("nearest", 0.99)})
    return out.withColumns({"latency_kept": F.col("p95") <= most_latency, "success_kept": F.col("success_rate") >= least_success})


def levels(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*SCENARIO, "level").agg(F.avg((~F.col("success")).cast("double")).alias("rate"))


def breaking_points(requests: DataFrame) -> DataFrame:
    """The first level at which over half fails, the first with any failure up to it, and the pattern
    of the way there: immediate, gradual, cliff or oscillating. Scenarios that hold have no row."""
    order = Window.partitionBy(*SCENARIO).orderBy("level")
    found = levels(requests).withColumns({"before": F.lag("rate").over(order), "place": F.row_number().over(order)})
    broken = found.groupBy(*SCENARIO).agg(F.min(F.when(F.col("rate") > 0.5, F.col("level"))).alias("threshold"))
    upto = found.join(broken.where("threshold is not null"), SCENARIO).where("level <= threshold")
    at = F.col("level") == F.col("threshold")
    one = upto.groupBy(*SCENARIO, "threshold").agg(
        F.max(F.when(at, F.col("rate"))).alias("failure_rate"), F.min(F.when(F.col("rate") > 0, F.col("level"))).alias("first_failure_at"),
        F.max("place").alias("steps"), F.count_if(F.col("rate") < F.col("before")).alias("falls"), F.max(F.when(at, F.col("rate") - F.col("before"))).alias("last_step"),
    )
    pattern = F.when(F.col("steps") == 1, "immediate").when((F.col("falls") == 0) & (F.col("steps") > 2), "gradual").when(F.col("last_step") > 0.3, "cliff").otherwise("oscillating")
    return one.select(*SCENARIO, "threshold", F.round("failure_rate", 6).alias("failure_rate"), "first_failure_at", pattern.alias("pattern"))


#: Types of tests whose breaking point is a level of concurrency, or a size of input; and those that recover.
BY_LEVEL, BY_SIZE, RECOVERING = ("load_ramp", "rate_limit_probe"), ("extreme_input", "context_overflow"), ("spike", "soak")


def typed_breaking_points(requests: DataFrame) -> DataFrame:
    """Breaking points by what a test (test_type, with level and input_size) varies; other types have none. Beyond a size,
    the pattern is a cliff."""
    level = breaking_points(requests.where(F.col("test_type").isin(*BY_LEVEL))).withColumn("metric", F.lit("concurrency"))
    sized = requests.where(F.col("test_type").isin(*BY_SIZE)).withColumn("level", F.col("input_size"))
    size = breaking_points(sized).withColumns({"pattern": F.lit("cliff"), "metric": F.lit("input_size")})
    return level.unionByName(size)


def typed_recovery(requests: DataFrame) -> DataFrame:
    """Recovery of the tests that have a peak to recover from; others have no row."""
    return recovery(requests.where(F.col("test_type").isin(*RECOVERING)))


def _beside(requests: DataFrame, found: DataFrame) -> DataFrame:
    """``requests`` with what was found of their scenarios; where those are few, requests stay where they are."""
    few = found.limit(MOST_SCENARIOS + 1).count() <= MOST_SCENARIOS
    return requests.join(F.broadcast(found) if few else found, SCENARIO)


def _earliest(requests: DataFrame, on: Column, into: str) -> DataFrame:
    """Per scenario the least ``at`` of the requests that ``on`` holds for, null if of none. Times are compared first, as numbers, so only
    requests of one time are put in order by their ties."""
    times = checkpoint(requests.groupBy(*SCENARIO).agg(F.min(F.when(on, F.col("_time"))).alias("_least")))
    tied = _beside(requests, times).where(on & (F.col("_time") == F.col("_least"))).groupBy(*SCENARIO).agg(F.min("at").alias(into))
    return checkpoint(times.select(*SCENARIO).join(tied, SCENARIO, "left"))


def recovery(requests: DataFrame, are_stored: bool = False) -> DataFrame:
    """First failure to the first success after it, and the success rate from then on (1 and no time
    if nothing failed or nothing recovered). Order: ts, then tie. Requests are read several times, so they are stored first, unless
    they ``are_stored``."""
    rows = requests.select(*SCENARIO, "success", "ts", "tie").dropna(subset=SCENARIO)
    time = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 63)))
    rows = (rows if are_stored else stored(rows)).withColumns({"at": F.struct("ts", "tie"), "_time": time})
    first = _earliest(rows, ~F.col("success"), "failed")
    back = _earliest(_beside(rows, first), F.col("success") & (F.col("at") > F.col("failed")), "back")
    rates = _beside(rows, back).groupBy(*SCENARIO).agg(F.avg(F.when(F.col("at") >= F.col("back"), F.col("success").cast("double"))).alias("rate"))
    after = first.join(back, SCENARIO).join(rates, SCENARIO)
    took = (F.unix_micros(F.col("back.ts").cast("timestamp")) - F.unix_micros(F.col("failed.ts").cast("timestamp"))) / 1000
    return after.select(*SCENARIO, F.when(F.col("back").isNotNull(), took).cast("long").alias("recovery_ms"), F.round(F.when(F.col("back").isNull(), 1.0).otherwise(F.col("rate")), 6).alias("stability"))


def robustness(requests: DataFrame) -> DataFrame:
    """Per provider and model: the score of success, breaking points and stability, sustainable
    concurrency, severity and the most common failure."""
    keys = ["provider", "model"]
    requests = stored(requests.select(*SCENARIO, "level", "success", "failure_mode", "ts", "tie"))
    rates = requests.groupBy(*SCENARIO).agg(F.avg(F.col("success").cast("double")).alias("rate"))
    scenarios = rates.join(breaking_points(requests).select(*SCENARIO, "first_failure_at"), SCENARIO, "left").join(recovery(requests, True).select(*SCENARIO, "stability"), SCENARIO)
    base = scenarios.groupBy(*keys).agg(
        F.avg("rate").alias("rate"), F.count("first_failure_at").alias("breaks"), F.avg("stability").alias("stability"), (F.min("first_failure_at") - 1).alias("max_concurrency")
    )
    modes = requests.where(~F.col("success")).groupBy(*keys, F.coalesce("failure_mode", F.lit("unknown")).alias("mode")).agg(F.count("*").alias("n"))
    common = modes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "mode")).getField("mode").alias("common_failure"))
    score = F.col("rate") * 0.5 + F.when(F.col("breaks") > 0, 0.5).otherwise(1.0) * 0.25 + F.col("stability") * 0.25
    severity = F.when(F.col("rate") < 0.5, "severe").when(F.col("rate") < 0.7, "moderate").when(F.col("rate") < 0.9, "mild").otherwise("none")
    return base.join(common, keys, "left").select(
        *keys, F.round(score, 6).alias("robustness"), F.col("max_concurrency").cast("int").alias("max_concurrency"),
        F.when(F.col("max_concurrency") != 0, F.floor(F.col("max_concurrency") * 0.8)).cast("long").alias("recommended_concurrency"), severity.alias("severity"), "common_failure",
    )
