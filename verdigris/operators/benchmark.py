"""Summaries of test results.

A result row has: test_id, provider, model, category, repository, status (success, failure, timeout
or skipped), duration_ms, prompt_tokens and completion_tokens (null without a response), ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.percentiles import with_percentiles

#: What a summary prices a thousand prompt and completion tokens at.
PROMPT_PER_1K, COMPLETION_PER_1K = 0.03, 0.06
#: What the views of a fleet read of its results.
SUMMED = ("provider", "category", "repository", "status", "duration_ms", "prompt_tokens", "completion_tokens")
RANKS = {"p50_duration_ms": ("rank", 0.5), "p95_duration_ms": ("rank", 0.95), "p99_duration_ms": ("rank", 0.99)}


def cost(prompt: Column | str = "prompt_tokens", completion: Column | str = "completion_tokens", per_prompt=PROMPT_PER_1K, per_completion=COMPLETION_PER_1K) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return col(prompt) / 1000 * F.lit(per_prompt) + col(completion) / 1000 * F.lit(per_completion)


def tokens() -> Column:
    return F.col("prompt_tokens") + F.col("completion_tokens")


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def of_status(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, success rate, durations, exact percentiles, tokens and cost of each group.

    Rows without a response count neither for tokens nor cost; tokens per success go by all successes.
    """
    base = results.groupBy(*keys).agg(
        F.count("*").alias("total"),
        of_status("success").alias("succeeded"),
        of_status("failure").alias("failed"),
        of_status("timeout").alias("timeout"),
        of_status("skipped").alias("skipped"),
        F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.coalesce(F.sum(tokens()), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.sum(cost()), F.lit(0.0)), 6).alias("total_cost"),
    )
    base = base.withColumns(
        {
            "success_rate": F.round(ratio(F.col("succeeded"), F.col("total")), 6),
            "avg_tokens_per_request": F.round(ratio(F.col("total_tokens"), F.col("succeeded")), 6),
        }
    )
    return with_percentiles(base, results, keys, "duration_ms", RANKS)


def fleet_summary(results: DataFrame) -> DataFrame:
    """One row for the whole fleet; percentiles are over all durations, not averaged over repositories."""
    whole = summary(results, [])
    repositories = results.groupBy("repository").agg(F.count("*").alias("n")).agg(F.count("*").alias("repositories"))
    return whole.crossJoin(F.broadcast(repositories)).select(
        "repositories", "total", "succeeded", "failed", "timeout", "skipped", "success_rate", "avg_duration_ms", "min_duration_ms", "max_duration_ms", *RANKS,
        "total_tokens", "total_cost",
        F.round(ratio(F.col("total_cost"), F.col("repositories")), 6).alias("avg_cost_per_repository"),
        F.round(ratio(F.col("total"), F.col("repositories")), 6).alias("avg_tests_per_repository"),
    )


def breakdown(results: DataFrame, key: str) -> DataFrame:
    """Per provider or category; rows without the key are left out. The mean duration is the true one."""
    return (
        results.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count_distinct("repository").alias("repositories"),
            F.count("*").alias("total"),
            of_status("success").alias("succeeded"),
            of_status("failure").alias("failed"),
            F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"),
            F.coalesce(F.sum(tokens()), F.lit(0)).alias("total_tokens"),
            F.round(F.coalesce(F.sum(cost()), F.lit(0.0)), 6).alias("total_cost"),
        )
        .withColumn("success_rate", F.round(ratio(F.col("succeeded"), F.col("total")), 6))
    )


def rates(results: DataFrame) -> DataFrame:
    return results.groupBy("repository").agg(F.round(ratio(of_status("success"), F.count("*")), 6).alias("success_rate"), F.count("*").alias("total"))


def best_and_worst(results: DataFrame) -> DataFrame:
    """The repositories of highest and lowest success rate: of equal ones the last is best, the first worst."""
    r = F.struct("success_rate", "repository")
    found = rates(results).agg(F.max(r).alias("best"), F.min(r).alias("worst"))
    return found.select(F.explode(F.array(F.struct(F.lit("best").alias("kind"), F.col("best").alias("r")), F.struct(F.lit("worst").alias("kind"), F.col("worst").alias("r")))).alias("x")).select(
        "x.kind", F.col("x.r.repository").alias("repository"), F.col("x.r.success_rate").alias("success_rate")
    )


def failing(results: DataFrame, below: float) -> DataFrame:
    return rates(results).where(F.col("success_rate") < below)


def rollup(results: DataFrame) -> DataFrame:
    """Overall, provider and category figures in one pass over the facts (grouping sets)."""
    view = results.select("provider", "category", "status", "duration_ms")
    return view.groupingSets([[], ["provider"], ["category"]], "provider", "category").agg(
        F.grouping_id().alias("level"), F.count("*").alias("total"), of_status("success").alias("succeeded"), F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms")
    )


def model_stats(results: DataFrame) -> DataFrame:
    """Per provider and model: latency over successes only, tokens and cost over all rows, tokens per
    second over successes that took time; 0 where there is no success. Percentiles by nearest rank."""
    ok = F.col("status") == "success"
    per_second = F.when(ok & (F.col("duration_ms") > 0), F.col("completion_tokens") / (F.col("duration_ms") / 1000))
    base = results.groupBy("provider", "model").agg(
        F.count("*").alias("executions"),
        F.count_if(ok).alias("succeeded"),
        F.round(ratio(F.count_if(ok), F.count("*")), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("duration_ms"))), F.lit(0.0)), 6).alias("latency_mean"),
        F.round(F.coalesce(F.stddev_pop(F.when(ok, F.col("duration_ms"))), F.lit(0.0)), 6).alias("latency_sd"),
        F.coalesce(F.min(F.when(ok, F.col("duration_ms"))), F.lit(0)).alias("latency_min"),
        F.coalesce(F.max(F.when(ok, F.col("duration_ms"))), F.lit(0)).alias("latency_max"),
        F.coalesce(F.sum(tokens()), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.sum(cost()), F.lit(0.0)), 6).alias("total_cost"),
        F.round(F.coalesce(F.avg(per_second), F.lit(0.0)), 6).alias("tokens_per_second"),
    )
    wanted = {f"latency_p{int(p * 100)}": ("nearest", p) for p in (0.5, 0.95, 0.99)}
    return with_percentiles(base, results.where(ok), ["provider", "model"], "duration_ms", wanted)


def analysis(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, extremes, the median as the mean of the middles, and p95."""
    base = results.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    return with_percentiles(base, results, keys, value, {"median": ("middle", 0.5), "p95": ("floor", 0.95)})


def metric(results: DataFrame, name: str) -> DataFrame:
    """(test_id, value) of the metric called latency or duration, cost, or tokens; other names are an error."""
    value = {"latency": F.col("duration_ms").cast("double"), "duration": F.col("duration_ms").cast("double"), "cost": cost(), "tokens": tokens().cast("double")}
    if name not in value:
        raise ValueError(f"unknown metric: {name}")
    return results.select("test_id", value[name].alias("value")).where("value is not null")


def histogram(results: DataFrame, bins: int) -> DataFrame:
    """Successes by bins of whole width (max - min + 1) / bins; the last takes what is beyond, and a
    width of 0 puts all in the first. Empty bins are listed."""
    ok = results.where("status = 'success'").select("duration_ms")
    ends = ok.agg(F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi")).withColumn("width", F.floor((F.col("hi") - F.col("lo") + 1) / bins).cast("long"))
    at = F.when(F.col("width") == 0, 0).otherwise(F.least(F.floor((F.col("duration_ms") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).cast("int")
    counts = ok.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.select("lo", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("from_ms"), F.coalesce("n", F.lit(0)).alias("n"))
