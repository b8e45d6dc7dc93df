"""How much responses change with perturbations of a prompt.

A run has: keys (what was perturbed, and how), ordinal, success, content, latency_ms, tokens. Runs of one perturbation are
few (a run is a call that is paid for), so their pairs are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import similarity as S


def aggregates(runs: DataFrame, base: DataFrame, keys: list[str], base_keys: list[str]) -> DataFrame:
    """Per perturbation: response variance (one less the mean similarity of the successful responses' pairs; 0 with fewer
    than two), mean similarity to the base responses (``base_keys``, content; 0 without any), mean latency, its population
    variance and mean tokens over successes only, and the rate of success."""
    ok = runs.where("success").withColumn("words", F.array_distinct(F.split(F.lower("content"), r"\s+")))
    other = ok.select(*keys, F.col("ordinal").alias("_j"), F.col("words").alias("_w"))
    alike = lambda a, b: S.set_jaccard(F.col(a), F.col(b), 0.0)
    pairs = ok.join(other, keys).where("ordinal < _j").groupBy(*keys).agg((1 - F.avg(alike("words", "_w"))).alias("response_variance"))
    first = base.select(*base_keys, F.array_distinct(F.split(F.lower("content"), r"\s+")).alias("_w"))
    to_base = ok.join(first, base_keys).groupBy(*keys).agg(F.avg(alike("words", "_w")).alias("similarity_to_base"))
    good = lambda c: F.when(F.col("success"), F.col(c))
    measured = runs.groupBy(*keys).agg(
        F.avg(good("latency_ms")).alias("avg_latency"), F.var_pop(good("latency_ms")).alias("var_latency"), F.avg(good("tokens")).alias("avg_tokens"), (F.count_if("success") / F.count("*")).alias("success_rate")
    )
    joined = measured.join(pairs, keys, "left").join(to_base, keys, "left")
    return joined.select(*keys, *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("response_variance", "similarity_to_base", "avg_latency", "var_latency", "avg_tokens", "success_rate")])


def overall(perturbations: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per ``keys``, over perturbations (``name``, place, response_variance): the mean variance, the most sensitive one (of
    equal ones the first by place) and the least (the last), two deviations of the mean to either side within 0 and 1, and
    whether the variances are steady."""
    v = F.col("response_variance")
    s = perturbations.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.count("*").alias("n"),
        F.max(F.struct(v.alias("v"), (-F.col("place")).alias("p"), name)).getField(name).alias("most_sensitive"), F.min(F.struct(v.alias("v"), (-F.col("place")).alias("p"), name)).getField(name).alias("least_sensitive"),
    )
    reach = 2 * F.col("sd") / F.sqrt("n")
    return s.select(
        *keys, F.round("mean", 6).alias("variance_score"), "most_sensitive", "least_sensitive", F.round(F.greatest(F.lit(0.0), F.col("mean") - reach), 6).alias("low"),
        F.round(F.least(F.lit(1.0), F.col("mean") + reach), 6).alias("high"), ((F.col("sd") < 0.2) & (F.col("n") >= 3)).alias("significant"),
    )
