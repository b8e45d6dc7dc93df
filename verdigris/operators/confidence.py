"""How far a result can be trusted: weighted sums of factors from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the factors.
BENCHMARK = {"success_rate": 0.4, "latency_consistency": 0.2, "provider_reliability": 0.2, "sample_size": 0.2}
REGRESSION = {"sample_size": 0.30, "significance": 0.30, "effect_size": 0.20, "consistency": 0.15, "coverage": 0.05}
CONSISTENCY = {"sample_size": 0.2, "outputs_per_group": 0.25, "method_reliability": 0.2, "content_length": 0.15, "score_variance": 0.2}
STRESS = {"sample_size": 0.25, "scenario_coverage": 0.20, "result_consistency": 0.25, "breaking_points": 0.15, "recovery": 0.15}
#: What stands in for a provider's history; reliability of similarity methods, and of others.
PROVIDER_RELIABILITY = 0.8
METHODS = {"exact_match": 1.0, "normalized_levenshtein": 0.9, "jaccard_tokens": 0.85, "character_ngram": 0.8, "word_ngram": 0.8, "cosine_tfidf": 0.75, "semantic_embedding": 0.7}


def weighed(weights: dict[str, float], factors: dict[str, Column]) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((factors[n] * w for n, w in weights.items()), F.lit(0.0))))


def log_share(n: Column, digits: int) -> Column:
    """Grows with the number of digits; 1 from 10 ** digits - 1 on."""
    return F.least(F.lit(1.0), F.log10(n + 1) / digits)


def of_benchmark(success_rate: Column, latency_mean: Column, latency_sd: Column, executions: Column) -> Column:
    """A mean latency of 0 leaves nothing of the latency's share."""
    steady = F.when(latency_mean > 0, F.greatest(F.lit(0.0), 1 - latency_sd / latency_mean)).otherwise(0.0)
    return weighed(BENCHMARK, {"success_rate": success_rate, "latency_consistency": steady, "provider_reliability": F.lit(PROVIDER_RELIABILITY), "sample_size": log_share(executions, 2)})


def of_regressions(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per model, from rows of metrics: n1, n2 (executions), p_value, effect, mean1, sd1. Means over metrics; a factor
    that no metric has counts as a half; four metrics are full coverage."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.5))
    factors = {
        "sample_size": log_share(F.max("n1") + F.max("n2"), 3), "significance": mean(1 - F.col("p_value")), "effect_size": mean(F.least(F.lit(1.0), F.abs("effect") / 2)),
        "consistency": F.least(F.lit(1.0), mean(F.when(F.col("mean1") != 0, F.greatest(F.lit(0.0), 1 - F.col("sd1") / F.abs("mean1"))))), "coverage": F.least(F.lit(1.0), F.count("*") / 4),
    }
    return found.groupBy(*keys).agg(F.round(weighed(REGRESSION, factors), 6).alias("confidence"))


def of_consistency(groups: DataFrame, method: str) -> DataFrame:
    """One row from groups: outputs, tokens (mean of the group, null if not counted) and score."""
    factors = {
        "sample_size": log_share(F.count("*"), 2), "outputs_per_group": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.avg("outputs") - 2) / 8)), "method_reliability": F.lit(METHODS.get(method, 0.7)),
        "content_length": F.when(F.count("tokens") == 0, 0.5).otherwise(F.least(F.lit(1.0), F.sum("tokens") / F.count("*") / 200)), "score_variance": F.greatest(F.lit(0.0), 1 - F.stddev_pop("score") * 2),
    }
    return groups.agg(F.round(weighed(CONSISTENCY, factors), 6).alias("confidence"))


def of_stress(scenarios: DataFrame) -> DataFrame:
    """One row from scenarios: test_type, requests, success_rate, breaks (whether it has breaking points) and recovered
    (whether recovery was seen). Nothing tested is no confidence."""
    seen = lambda c: F.when(F.bool_or(c), 1.0).otherwise(0.5)
    factors = {
        "sample_size": log_share(F.sum("requests"), 3), "scenario_coverage": F.least(F.lit(1.0), F.count_distinct("test_type") / 5), "result_consistency": F.greatest(F.lit(0.0), 1 - F.stddev_pop("success_rate")),
        "breaking_points": seen("breaks"), "recovery": seen("recovered"),
    }
    return scenarios.agg(F.round(F.when(F.coalesce(F.sum("requests"), F.lit(0)) > 0, weighed(STRESS, factors)).otherwise(0.0), 6).alias("confidence"))
