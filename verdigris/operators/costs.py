"""What usage costs: price tables, savings, expensive usage and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import benchmark

#: Source, provider (null: any), model, how it is compared, price of ``unit`` prompt and completion tokens,
#: unit. The tables contradict each other, so the source is part of the key. Rows of a source are tried in order; the
#: model ``*`` is what a source takes for models it doesn't know.
PRICES = (
    ("optimizer", None, "gpt-4", "is", 0.03, 0.06, 1000), ("optimizer", None, "gpt-4-turbo", "is", 0.01, 0.03, 1000), ("optimizer", None, "gpt-4o", "is", 0.005, 0.015, 1000),
    ("optimizer", None, "gpt-4o-mini", "is", 0.00015, 0.0006, 1000), ("optimizer", None, "gpt-3.5-turbo", "is", 0.0015, 0.002, 1000), ("optimizer", None, "gpt-3.5-turbo-16k", "is", 0.003, 0.004, 1000),
    ("optimizer", None, "claude-3-opus", "is", 0.015, 0.075, 1000), ("optimizer", None, "claude-3-sonnet", "is", 0.003, 0.015, 1000), ("optimizer", None, "claude-3-haiku", "is", 0.00025, 0.00125, 1000),
    ("optimizer", None, "claude-3-5-sonnet", "is", 0.003, 0.015, 1000),
    ("comparison", None, "gpt-4", "is", 0.03, 0.06, 1000), ("comparison", None, "gpt-4-turbo", "is", 0.01, 0.03, 1000), ("comparison", None, "gpt-3.5-turbo", "is", 0.0005, 0.0015, 1000),
    ("comparison", None, "claude-3-opus-20240229", "is", 0.015, 0.075, 1000), ("comparison", None, "claude-3-sonnet-20240229", "is", 0.003, 0.015, 1000),
    ("comparison", None, "claude-3-haiku-20240307", "is", 0.00025, 0.00125, 1000), ("comparison", None, "*", "any", 0.001, 0.002, 1000),
    ("judge", None, "gpt-4", "is", 0.03, 0.06, 1000), ("judge", None, "gpt-4-0613", "is", 0.03, 0.06, 1000), ("judge", None, "gpt-4-turbo", "is", 0.01, 0.03, 1000), ("judge", None, "gpt-4-turbo-preview", "is", 0.01, 0.03, 1000),
    ("judge", None, "gpt-4-1106-preview", "is", 0.01, 0.03, 1000), ("judge", None, "gpt-3.5-turbo", "is", 0.0005, 0.0015, 1000), ("judge", None, "gpt-3.5-turbo-0125", "is", 0.0005, 0.0015, 1000),
    ("judge", None, "claude-3-opus-20240229", "is", 0.015, 0.075, 1000), ("judge", None, "claude-3-sonnet-20240229", "is", 0.003, 0.015, 1000), ("judge", None, "claude-3-haiku-20240307", "is", 0.00025, 0.00125, 1000),
    ("judge", None, "*", "any", 0.01, 0.03, 1000),
    ("optimize command", "openai", "gpt-4-turbo", "has", 10.0, 30.0, 1000000), ("optimize command", "openai", "gpt-4", "has", 30.0, 60.0, 1000000), ("optimize command", "openai", "gpt-3.5-turbo", "has", 0.5, 1.5, 1000000),
    ("optimize command", "anthropic", "opus", "has", 15.0, 75.0, 1000000), ("optimize command", "anthropic", "sonnet", "has", 3.0, 15.0, 1000000), ("optimize command", "anthropic", "haiku", "has", 0.25, 1.25, 1000000),
    ("optimize command", None, "*", "any", 1.0, 2.0, 1000000),
    ("runner agent", None, "gpt-4o", "is", 0.0025, 0.01, 1000), ("runner agent", None, "gpt-4o-mini", "is", 0.00015, 0.0006, 1000), ("runner agent", None, "claude-3-5-sonnet-20241022", "is", 0.003, 0.015, 1000),
    ("runner agent", None, "claude-3-5-haiku-20241022", "is", 0.0008, 0.004, 1000), ("runner agent", None, "*", "any", 0.0, 0.0, 1000),
    ("compare command", "openai", "gpt-4", "has", 0.03, 0.06, 1000), ("compare command", "openai", "*", "any", 0.0015, 0.002, 1000), ("compare command", "anthropic", "*", "any", 0.015, 0.075, 1000),
    ("compare command", None, "*", "any", 0.001, 0.002, 1000),
    ("runner", None, "*", "any", 0.03, 0.06, 1000),
)
PRICE_SCHEMA = "source string, provider string, model string, compared string, per_prompt double, per_completion double, unit int, place int"
#: What a saving takes for the model in use, and for the one recommended, if the table has neither.
CURRENT_DEFAULT, RECOMMENDED_DEFAULT = (0.03, 0.06), (0.01, 0.02)
#: Tokens of a request that savings are reckoned with.
PROMPT_TOKENS, COMPLETION_TOKENS = 100, 50


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, k) for k, row in enumerate(PRICES)], PRICE_SCHEMA)


def request_price(source: str, provider: Column, model: Column, prompt: Column, completion: Column, otherwise: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Price of a request by a source's table: its first row that fits; ``otherwise`` (per 1,000) if none does."""
    rows = [r for r in PRICES if r[0] == source]
    if not rows:
        raise ValueError(f"unknown price table: {source}")
    price = prompt / 1000 * otherwise[0] + completion / 1000 * otherwise[1]
    for _, who, name, compared, a, b, unit in reversed(rows):
        fits = {"is": model == name, "has": F.contains(model, F.lit(name)), "any": F.lit(True)}[compared]
        if who:
            fits = fits & (provider == who)
        price = F.when(fits, prompt / unit * a + completion / unit * b).otherwise(price)
    return price


def savings(current: Column, recommended: Column, monthly_requests: Column) -> Column:
    """What a month's requests cost less with the other model, by the optimizer's table."""
    p, c, nobody = F.lit(float(PROMPT_TOKENS)), F.lit(float(COMPLETION_TOKENS)), F.lit("")
    a = request_price("optimizer", nobody, current, p, c, CURRENT_DEFAULT)
    return (a - request_price("optimizer", nobody, recommended, p, c, RECOMMENDED_DEFAULT)) * monthly_requests


def usage(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per benchmark: tests, mean tokens over all tests (those without an answer count as 0), cost and success rate."""
    n = F.count("*")
    mean = lambda c: F.coalesce(F.sum(c), F.lit(0)) / n
    return results.groupBy(*keys).agg(
        n.alias("tests"), mean("prompt_tokens").alias("avg_prompt"), mean("completion_tokens").alias("avg_completion"),
        F.coalesce(F.sum(benchmark.cost()), F.lit(0.0)).alias("cost"), (F.count_if(F.col("status") == "success") / n).alias("success_rate"),
    )


def expensive_patterns(results: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each pattern that a benchmark shows: long prompts (over 1,000 tokens in the mean), verbose responses
    (over 500), a dear model (over 0.05 a test) where over 98 % succeed; and what could be saved."""
    u = usage(results, keys).withColumn("average_cost", F.col("cost") / F.col("tests"))
    p, c, n, each = F.col("avg_prompt"), F.col("avg_completion"), F.col("tests"), F.col("average_cost")
    made = [
        ("long_prompts", p > 1000, (p - 800) / 1000 * 0.03 * n, F.format_string("Long prompts detected (avg %.0f tokens). Consider compression or summarization.", p)),
        ("verbose_responses", c > 500, (c - 300) / 1000 * 0.06 * n, F.format_string("Verbose responses detected (avg %.0f tokens). Consider setting max_tokens limit.", c)),
        ("expensive_model", (each > 0.05) & (F.col("success_rate") > 0.98), each * 0.5 * n, F.format_string("Using expensive model with %.1f%% success rate. Consider cheaper alternatives for high-success tasks.", F.col("success_rate") * 100)),
    ]
    some = F.filter(F.array(*[F.when(on, F.struct(F.lit(k).alias("pattern"), d.alias("description"), s.alias("potential_savings"))) for k, on, s, d in made]), lambda x: x.isNotNull())
    return u.select(*keys, "average_cost", F.col("tests").alias("frequency"), F.inline(some))


def suggestions(results: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each suggestion to a benchmark: title, effort and estimated savings."""
    u = usage(results, keys)
    p, c, n = F.col("avg_prompt"), F.col("avg_completion"), F.col("tests")
    made = [
        ("Compress Long Prompts", "medium", p > 1000, (p - 700) / 1000 * 0.03 * n), ("Set Response Length Limits", "low", c > 500, (c - 300) / 1000 * 0.06 * n),
        ("Use Batch Processing", "high", n > 100, F.col("cost") * 0.1), ("Optimize Temperature Settings", "low", F.col("success_rate") > 0.95, F.lit(0.0)),
    ]
    some = F.filter(F.array(*[F.when(on, F.struct(F.lit(t).alias("title"), F.lit(e).alias("effort"), v.alias("estimated_savings"))) for t, e, on, v in made]), lambda x: x.isNotNull())
    return u.select(*keys, F.inline(some))
