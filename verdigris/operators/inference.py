"""Significance tests, effect sizes and regression detection over aggregated moments.

All work on one row per comparison with n1, mean1, var1, n2, mean2, var2 (or sd1, sd2). The moments
come from partial aggregates; no group's values are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import stats
from verdigris.functions.ranges import tied
from verdigris.functions.running import running_sum

ALPHA = 0.05


def moments(values: DataFrame, keys: list[str], side: str, first, second, value: str) -> DataFrame:
    """n, mean and sample variance of ``value`` on both sides, one row per ``keys``; variance 0 if n < 2."""
    on = lambda s: F.when(F.col(side) == s, F.col(value))
    out = []
    for k, s in ((1, first), (2, second)):
        out += [F.count(on(s)).alias(f"n{k}"), F.avg(on(s)).alias(f"mean{k}"), F.coalesce(F.var_samp(on(s)), F.lit(0.0)).alias(f"var{k}")]
    return values.groupBy(*keys).agg(*out)


def welch(m: DataFrame, confidence: float = 0.95) -> DataFrame:
    """t, degrees of freedom, two-sided p by Student's t, and the confidence interval of mean1 - mean2.

    Groups with fewer than two values on a side are left out, as they have no test.
    """
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    m = m.where("n1 >= 2 and n2 >= 2").withColumn("se", F.sqrt(a + b))
    df = F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n1") - 1) + F.pow(b, 2) / (F.col("n2") - 1))
    m = m.withColumns({"t": (F.col("mean1") - F.col("mean2")) / F.col("se"), "df": df})
    m = m.withColumn("p_value", stats.t_p_value("t", "df"))
    reach = stats.quantile_t(F.lit(1 - (1 - confidence) / 2), F.col("df")) * F.col("se")
    difference = F.col("mean1") - F.col("mean2")
    return m.withColumns({"ci_low": difference - reach, "ci_high": difference + reach, "df": F.floor("df"), "significant": F.col("p_value") < 1 - confidence})


#: Fixed value: values nearer than this to the first of their group are ties.
TIE = 1e-10


def mann_whitney(values: DataFrame, side: str, first, second, value: str) -> DataFrame:
    """U, z and the normal two-sided p, ties sharing their mean rank; no tie or continuity correction.

    Values are ties if they are nearer than ``TIE`` to the first of their group, in rising order. Ranks come from counts per
    group, so ties are never spread over rows. Values that are not numbers are left out.
    """
    kept = values.where(F.col(side).isin(first, second) & F.col(value).isNotNull()).select(side, F.col(value).cast("double").alias("v")).where(~F.isnan("v"))
    counts = kept.groupBy("v").agg(F.count("*").alias("c"), F.count_if(F.col(side) == first).alias("c1"))
    groups = tied(counts, "v", TIE, "first").groupBy("first").agg(F.sum("c").alias("c"), F.sum("c1").alias("c1"))
    ranked = running_sum(groups, "first", F.col("c"), "upto").withColumn("rank", F.col("upto") - F.col("c") + (F.col("c") + 1) / 2)
    t = ranked.agg(F.sum(F.col("rank") * F.col("c1")).alias("r1"), F.sum("c1").cast("double").alias("n1"), F.sum(F.col("c") - F.col("c1")).cast("double").alias("n2"))
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    t = t.withColumn("u", F.least(u1, F.col("n1") * F.col("n2") - u1))
    z = (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return t.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u", z.alias("z"), (2 * (1 - stats.normal_cdf(F.abs(z)))).alias("p_value"))


def cohens_d() -> Column:
    """From n1, mean1, var1, n2, mean2, var2; 0 if the pooled variance is."""
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / (F.col("n1") + F.col("n2") - 2)
    return F.when(pooled > 0, (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled)).otherwise(0.0)


def improvement(m: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Moments with improved and interpretation: an improvement is a significantly lower mean on the second side, whatever
    the metric. Groups without a test are left out."""
    tested = welch(m, confidence).withColumn("d", cohens_d())
    better = F.col("significant") & (F.col("mean2") < F.col("mean1"))
    say = lambda what: F.format_string(f"{what} (p=%.4f, d=%.2f)", "p_value", "d")
    return tested.withColumns({"improved": better, "interpretation": F.when(better, say("Significant improvement")).otherwise(say("No significant improvement"))})


def pooled_effect() -> Column:
    """Cohen's d of the second side against the first, from n1, mean1, sd1, n2, mean2, sd2; 0 if nothing varies."""
    spread = F.try_divide((F.col("n1") - 1) * F.pow("sd1", 2) + (F.col("n2") - 1) * F.pow("sd2", 2), F.col("n1") + F.col("n2") - 2)
    return F.when(spread > 0, (F.col("mean2") - F.col("mean1")) / F.sqrt(spread)).otherwise(0.0)


def mean_interval(values: DataFrame, keys: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    m = values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    reach = F.when(F.col("n") > 1, stats.quantile_t(F.lit(1 - (1 - confidence) / 2), (F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt(F.col("n"))).otherwise(0.0)
    return m.select(*keys, "n", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - reach, 6).alias("low"), F.round(F.col("mean") + reach, 6).alias("high"))


def stepped_p(t: Column) -> Column:
    """p of a t value read off a table of steps."""
    size = F.abs(t)
    return F.when(size > 3.0, 0.001).when(size > 2.576, 0.01).when(size > 1.96, 0.05).when(size > 1.645, 0.1).otherwise(0.2)


def verdict(m: DataFrame, confidence: float = 0.95, least_effect: float = 0.2) -> DataFrame:
    """Regression, improvement or no change of a metric for which higher is worse, from moments with
    the baseline first. ``1 - confidence`` is taken as it comes out in binary: 0.05 is below it."""
    t = (F.col("mean2") - F.col("mean1")) / F.sqrt(F.col("var1") / F.col("n1") + F.col("var2") / F.col("n2"))
    d = F.abs(F.col("mean2") - F.col("mean1")) / F.sqrt((F.col("var1") + F.col("var2")) / 2)
    m = m.withColumns({"t": t, "effect": d}).withColumn("p_value", stepped_p(F.col("t")))
    m = m.withColumn("significant", F.col("p_value") < F.lit(1.0) - F.lit(confidence))
    change = F.col("mean2") - F.col("mean1")
    return m.withColumn(
        "verdict",
        F.when(F.col("significant") & (change > 0) & (F.col("effect") >= least_effect), "regression").when(F.col("significant") & (change < 0), "improvement").otherwise("no_change"),
    )


#: Metrics of a run, whether higher is worse, and the thresholds of critical, major and
#: minor regressions; those of the success rate are absolute, the others relative.
METRICS = (
    ("latency", True, False, 0.50, 0.25, 0.10),
    ("throughput", False, False, 0.50, 0.25, 0.10),
    ("success_rate", False, True, 0.10, 0.05, 0.02),
    ("cost", True, False, 0.50, 0.25, 0.10),
)


def regressions(runs: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    """One row per model and metric that both sides have. ``runs``: keys, side (baseline or candidate),
    and a column per metric. Welch's statistic on population deviations, p by the normal law."""
    stacked = runs.select(*keys, "side", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n, *_ in METRICS])))
    on = lambda s: F.when(F.col("side") == s, F.col("value"))
    agg = []
    for k, s in ((1, "baseline"), (2, "candidate")):
        agg += [F.count(on(s)).alias(f"n{k}"), F.avg(on(s)).alias(f"mean{k}"), F.stddev_pop(on(s)).alias(f"sd{k}")]
    m = stacked.groupBy(*keys, "metric").agg(*agg).where("n1 > 0 and n2 > 0")
    pick = lambda at: F.coalesce(*[F.when(F.col("metric") == row[0], F.lit(row[at])) for row in METRICS])
    se = F.sqrt(F.pow("sd1", 2) / F.col("n1") + F.pow("sd2", 2) / F.col("n2"))
    change = F.col("mean2") - F.col("mean1")
    m = m.withColumns({
        "absolute_change": change,
        "percentage_change": F.when(F.col("mean1") != 0, change / F.col("mean1")).otherwise(0.0),
        "t": F.when(se == 0, 0.0).otherwise(change / se),
        "p_value": F.when(se == 0, 1.0).otherwise(2 * (1 - stats.normal_cdf(F.abs(change / se)))),
        "effect": pooled_effect(),
        "worse_up": pick(1),
    })
    pct = F.col("percentage_change")
    worse = F.when(F.col("worse_up"), pct > 0).otherwise(pct < 0)
    size = F.when(pick(2), F.abs("absolute_change")).otherwise(F.abs(pct))
    m = m.withColumn("significant", F.col("p_value") < F.lit(1.0) - F.lit(confidence))
    m = m.withColumn("direction", F.when(F.abs(pct) < 0.01, "unchanged").when(worse, "degraded").otherwise("improved"))
    severity = F.when(~F.col("significant") | ~worse, "none").when(size >= pick(3), "critical").when(size >= pick(4), "major").when(size >= pick(5), "minor").otherwise("none")
    m = m.withColumn("severity", severity)
    return m.withColumn("is_regression", (F.col("direction") == "degraded") & F.col("significant") & (F.col("severity") != "none")).drop("worse_up")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 3).when(severity == "major", 2).when(severity == "minor", 1).otherwise(0)


def regression_rollup(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per model: how many metrics regress, and the worst severity."""
    worst = F.max(severity_rank(F.col("severity")))
    return found.groupBy(*keys).agg(
        F.count_if("is_regression").alias("regressions"),
        F.element_at(F.array(*map(F.lit, ("none", "minor", "major", "critical"))), (worst + 1).cast("int")).alias("worst"),
    )
