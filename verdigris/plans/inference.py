"""Queries and SQL: statistics, regression, ranking, routing, cost, stress."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import stats
from verdigris.operators import benchmark, inference, ranking, stress
from verdigris.plans.fixtures import MODELS, RESULTS, model_results, results, table

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def erf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x})))"
    poly = f"((((1.061405429::DOUBLE * {t} + -1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} + -0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


def phi_sql(x: str) -> str:
    return f"((1 + {erf_sql(f'(({x}) / sqrt(2.0))')}) / 2)"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def by_provider(spark, sf):
    """Durations of providers A (first) and N (second), by category."""
    return inference.moments(results(spark, sf), ["category"], "provider", "A", "N", "duration_ms")


MOMENTS = f"""WITH {RESULTS}, m AS (SELECT category, count(*) FILTER (provider = 'A') AS n1, avg(duration_ms) FILTER (provider = 'A') AS mean1, coalesce(var_samp(duration_ms) FILTER (provider = 'A'), 0.0) AS var1,
  count(*) FILTER (provider = 'N') AS n2, avg(duration_ms) FILTER (provider = 'N') AS mean2, coalesce(var_samp(duration_ms) FILTER (provider = 'N'), 0.0) AS var2 FROM r GROUP BY category)"""


@query(
    "STA1_welch",
    MOMENTS
    + """ SELECT category, n1, round(mean1, 6) AS mean1, n2, round(mean2, 6) AS mean2, round((mean1 - mean2) / sqrt(var1 / n1 + var2 / n2), 6) AS t,
  CAST(floor(power(var1 / n1 + var2 / n2, 2) / (power(var1 / n1, 2) / (n1 - 1) + power(var2 / n2, 2) / (n2 - 1))) AS BIGINT) AS df FROM m""",
)
def sta1(spark, sf):
    return rounded(inference.welch(by_provider(spark, sf)), "mean1", "mean2", "t").select("category", "n1", "mean1", "n2", "mean2", "t", "df")


@query("STA1_welch_p")
def sta1p(spark, sf):
    return rounded(inference.welch(by_provider(spark, sf)), "p_value", "ci_low", "ci_high").select("category", "p_value", "ci_low", "ci_high", "significant")


@query(
    "STA2_mann_whitney",
    f"""WITH {RESULTS}, v AS (SELECT provider, duration_ms AS v, rank() OVER (ORDER BY duration_ms) + (count(*) OVER (PARTITION BY duration_ms) - 1) / 2.0 AS rk FROM r WHERE provider IN ('A', 'N')),
    t AS (SELECT sum(rk) FILTER (provider = 'A') AS r1, count(*) FILTER (provider = 'A') AS n1, count(*) FILTER (provider = 'N') AS n2 FROM v),
    u AS (SELECT n1, n2, least(r1 - n1 * (n1 + 1) / 2.0, n1::DOUBLE * n2 - (r1 - n1 * (n1 + 1) / 2.0)) AS u FROM t),
    z AS (SELECT *, (u - n1::DOUBLE * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12) AS z FROM u)
    SELECT n1, n2, round(u, 3) AS u, round(z, 6) AS z, round(2 * (1 - {phi_sql('abs(z)')}), 6) AS p_value FROM z""",
)
def sta2(spark, sf):
    return rounded(inference.mann_whitney(results(spark, sf), "provider", "A", "N", "duration_ms"), "z", "p_value").withColumn("u", F.round("u", 3))


D = "CASE WHEN ((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) > 0 THEN (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)) ELSE 0.0 END"
BAND = "CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END"


@query("STA3_cohens_d", f"{MOMENTS}, e AS (SELECT category, {D} AS d FROM m) SELECT category, round(d, 6) AS d, {BAND} AS band FROM e")
def sta3(spark, sf):
    found = by_provider(spark, sf).select("category", inference.cohens_d().alias("d"))
    return found.select("category", F.round("d", 6).alias("d"), stats.effect_band(F.col("d")).alias("band"))


def quantile_sql(p: str) -> str:
    a, b, c, d = (["%r::DOUBLE" % x for x in row] for row in (stats.QUANTILE_A, stats.QUANTILE_B, stats.QUANTILE_C, stats.QUANTILE_D))

    def horner(x, row):
        out = row[0]
        for k in row[1:]:
            out = f"({out} * {x} + {k})"
        return out

    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    sq = f"({mid} * {mid})"
    tail = lambda q: f"({horner(q, c)} / {horner(q, [*d, '1.0'])})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} <= 0.97575 THEN {horner(sq, a)} * {mid} / {horner(sq, [*b, '1.0'])} ELSE -{tail(high)} END"


@query(
    "STA4_mean_interval",
    f"""WITH {RESULTS}, s AS (SELECT category, count(duration_ms) AS n, avg(duration_ms) AS mean, coalesce(stddev_samp(duration_ms), 0.0) AS sd FROM r GROUP BY category)
    SELECT category, n, round(mean, 6) AS mean, round(mean - {quantile_sql('0.975::DOUBLE')} * sd / sqrt(n), 6) AS low, round(mean + {quantile_sql('0.975::DOUBLE')} * sd / sqrt(n), 6) AS high FROM s""",
)
def sta4(spark, sf):
    return inference.mean_interval(results(spark, sf), ["category"], "duration_ms")


@query("STA5_quantile_t")
def sta5(spark, sf):
    grid = spark.range(1, 60).select(F.col("id").cast("double").alias("df"))
    return grid.select("df", F.round(stats.quantile_t(F.lit(0.975), F.col("df")), 4).alias("quantile"))


@query("STA6_normal_quantile", f"SELECT p_partkey, round({quantile_sql('(p_size / 51.0)')}, 6) AS quantile FROM part")
def sta6(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(stats.normal_quantile(F.col("p_size") / 51.0), 6).alias("quantile"))


@query("STA7_erf", f"SELECT p_partkey, round({erf_sql('(p_size / 25.0 - 1)')}, 6) AS erf, round({phi_sql('(p_size / 25.0 - 1)')}, 6) AS cdf FROM part")
def sta7(spark, sf):
    x = F.col("p_size") / 25.0 - 1
    return table(spark, sf, "part").select("p_partkey", F.round(stats.erf(x), 6).alias("erf"), F.round(stats.normal_cdf(x), 6).alias("cdf"))


@query("STA8_improvement")
def sta8(spark, sf):
    """Provider N against A."""
    return inference.improvement(by_provider(spark, sf)).select("category", "improved", "interpretation")


VERDICT = """, v AS (SELECT *, (mean2 - mean1) / sqrt(var1 / n1 + var2 / n2) AS t, abs(mean2 - mean1) / sqrt((var1 + var2) / 2) AS effect FROM m),
  p AS (SELECT *, CASE WHEN abs(t) > 3.0 THEN 0.001 WHEN abs(t) > 2.576 THEN 0.01 WHEN abs(t) > 1.96 THEN 0.05 WHEN abs(t) > 1.645 THEN 0.1 ELSE 0.2 END::DOUBLE AS p_value FROM v),
  s AS (SELECT *, p_value < 1.0::DOUBLE - 0.95::DOUBLE AS significant FROM p)"""


@query("STA9_stepped_test", MOMENTS + VERDICT + " SELECT category, round(t, 6) AS t, p_value, significant, round(effect, 6) AS effect FROM s")
def sta9(spark, sf):
    return rounded(inference.verdict(by_provider(spark, sf)), "t", "effect").select("category", "t", "p_value", "significant", "effect")


@query(
    "STA10_verdict",
    MOMENTS + VERDICT + " SELECT category, CASE WHEN significant AND mean2 > mean1 AND effect >= 0.0 THEN 'regression' WHEN significant AND mean2 < mean1 THEN 'improvement' ELSE 'no_change' END AS verdict FROM s",
)
def sta10(spark, sf):
    return inference.verdict(by_provider(spark, sf), least_effect=0.0).select("category", "verdict")


def runs(spark, sf):
    """A run is a provider's model's month; the baseline ends with June 1998."""
    r = results(spark, sf).withColumns({"side": F.when(F.col("ts") < F.lit("1998-07-01").cast("timestamp"), "baseline").otherwise("candidate"), "month": F.date_trunc("month", "ts")})
    return r.groupBy("provider", "model", "side", "month").agg(
        F.avg("duration_ms").alias("latency"), F.avg(F.col("completion_tokens") / (F.col("duration_ms") / 1000)).alias("throughput"),
        (F.count_if(F.col("status") == "success") / F.count("*")).alias("success_rate"), F.avg(benchmark.cost()).alias("cost"),
    )


REGRESSIONS = f"""WITH {RESULTS}, runs AS (SELECT provider, model, CASE WHEN ts < TIMESTAMP '1998-07-01' THEN 'baseline' ELSE 'candidate' END AS side, date_trunc('month', ts) AS month,
    avg(duration_ms) AS latency, avg(completion_tokens / (duration_ms / 1000.0)) AS throughput, count(*) FILTER (status = 'success') / count(*)::DOUBLE AS success_rate, avg(cost) AS cost FROM rc GROUP BY ALL),
  st AS (SELECT provider, model, side, unnest(['latency', 'throughput', 'success_rate', 'cost']) AS metric, unnest([latency, throughput, success_rate, cost]) AS value FROM runs),
  m AS (SELECT provider, model, metric, count(value) FILTER (side = 'baseline') AS n1, avg(value) FILTER (side = 'baseline') AS mean1, stddev_pop(value) FILTER (side = 'baseline') AS sd1,
    count(value) FILTER (side = 'candidate') AS n2, avg(value) FILTER (side = 'candidate') AS mean2, stddev_pop(value) FILTER (side = 'candidate') AS sd2 FROM st GROUP BY ALL),
  c AS (SELECT *, mean2 - mean1 AS ac, CASE WHEN mean1 <> 0 THEN (mean2 - mean1) / mean1 ELSE 0.0 END AS pc, sqrt(sd1 * sd1 / n1 + sd2 * sd2 / n2) AS se FROM m WHERE n1 > 0 AND n2 > 0),
  t AS (SELECT *, CASE WHEN se = 0 THEN 0.0 ELSE ac / se END AS t, CASE WHEN se = 0 THEN 1.0 ELSE 2 * (1 - {phi_sql('abs(ac / se)')}) END AS p,
    CASE WHEN metric IN ('latency', 'cost') THEN pc > 0 ELSE pc < 0 END AS worse, CASE WHEN metric = 'success_rate' THEN abs(ac) ELSE abs(pc) END AS size,
    CASE WHEN metric = 'success_rate' THEN [0.1, 0.05, 0.02] ELSE [0.5, 0.25, 0.1] END AS th FROM c),
  f AS (SELECT *, p < 1.0::DOUBLE - 0.95::DOUBLE AS significant, CASE WHEN abs(pc) < 0.01 THEN 'unchanged' WHEN worse THEN 'degraded' ELSE 'improved' END AS direction FROM t),
  g AS (SELECT *, CASE WHEN NOT significant OR NOT worse THEN 'none' WHEN size >= th[1] THEN 'critical' WHEN size >= th[2] THEN 'major' WHEN size >= th[3] THEN 'minor' ELSE 'none' END AS severity FROM f),
  h AS (SELECT *, direction = 'degraded' AND significant AND severity <> 'none' AS is_regression FROM g)"""


@query(
    "STA13_regression_detection",
    REGRESSIONS + " SELECT provider, model, metric, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(pc, 6) AS percentage_change, round(t, 6) AS t, round(p, 6) AS p_value, direction, severity, is_regression FROM h",
)
def sta13(spark, sf):
    found = rounded(inference.regressions(runs(spark, sf), ["provider", "model"]), "mean1", "mean2", "percentage_change", "t", "p_value")
    return found.select("provider", "model", "metric", "n1", "n2", "mean1", "mean2", "percentage_change", "t", "p_value", "direction", "severity", "is_regression")


@query(
    "AGG20_regression_rollup",
    REGRESSIONS
    + """ SELECT provider, model, count(*) FILTER (is_regression) AS regressions,
      (['none', 'minor', 'major', 'critical'])[max(CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END) + 1] AS worst FROM h GROUP BY provider, model""",
)
def agg20(spark, sf):
    return inference.regression_rollup(inference.regressions(runs(spark, sf), ["provider", "model"]), ["provider", "model"])


@query(
    "STA12_effect_bands",
    MOMENTS + f", e AS (SELECT category, (mean2 - mean1) / sqrt((var1 + var2) / 2) AS d FROM m) SELECT category, round(d, 6) AS d, {BAND} AS band FROM e",
)
def sta12(spark, sf):
    d = (F.col("mean2") - F.col("mean1")) / F.sqrt((F.col("var1") + F.col("var2")) / 2)
    return by_provider(spark, sf).select("category", F.round(d, 6).alias("d"), stats.effect_band(d).alias("band"))


POOLED = "CASE WHEN n1 + n2 > 2 AND ((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) > 0 THEN (mean2 - mean1) / sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)) ELSE 0.0 END"


@query("STA12_pooled_effect", REGRESSIONS + f", x AS (SELECT *, {POOLED} AS d FROM h) SELECT provider, model, metric, round(d, 6) AS d, {BAND} AS band FROM x")
def sta12_pooled(spark, sf):
    found = inference.regressions(runs(spark, sf), ["provider", "model"])
    return found.select("provider", "model", "metric", F.round("effect", 6).alias("d"), stats.effect_band(F.col("effect")).alias("band"))


QUALITY = """(coalesce(faithfulness * 0.4, 0) + coalesce(relevance * 0.3, 0) + coalesce(coherence * 0.3, 0)) /
  (CASE WHEN faithfulness IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN relevance IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN coherence IS NULL THEN 0 ELSE 0.3::DOUBLE END)"""
SCORED = f"""WITH {MODELS}, q AS (SELECT *, {QUALITY} AS quality FROM m WHERE success), k AS (SELECT *, CASE WHEN cost <= 0 THEN quality ELSE quality / cost END AS per_cost FROM q),
  e AS (SELECT min(latency_ms) AS lo, max(latency_ms) AS hi, max(per_cost) AS top, avg(quality) AS aq, avg(latency_ms) AS al, avg(cost) AS ac FROM k),
  s AS (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE 1 - (latency_ms - lo) / (hi - lo)::DOUBLE END AS performance, CASE WHEN top <= 0 THEN 0.0 ELSE per_cost / top END AS cost_efficiency FROM k, e),
  o AS (SELECT *, quality * 0.6 + performance * 0.2 + cost_efficiency * 0.2 AS overall FROM s), rk AS (SELECT *, row_number() OVER (ORDER BY round(overall, 9) DESC, ordinal) AS rank FROM o)"""


@query("WIN1_ranking", SCORED + " SELECT CAST(rank AS INT) AS rank, model, round(quality, 6) AS quality, round(performance, 6) AS performance, round(cost_efficiency, 6) AS cost_efficiency, round(overall, 6) AS overall FROM rk")
def win1(spark, sf):
    return rounded(ranking.ranked(model_results(spark, sf)), "quality", "performance", "cost_efficiency", "overall").select("rank", "model", "quality", "performance", "cost_efficiency", "overall")


@query(
    "WIN5_traits",
    SCORED
    + """ SELECT model, coalesce(nullif(concat_ws('; ', CASE WHEN quality > aq + 0.1 THEN 'High quality responses' END, CASE WHEN latency_ms < al * 0.8 THEN 'Fast response time' END, CASE WHEN cost < ac * 0.8 THEN 'Cost-effective' END), ''), 'Balanced performance') AS strengths,
    concat_ws('; ', CASE WHEN quality < aq - 0.1 THEN 'Lower quality scores' END, CASE WHEN latency_ms > al * 1.2 THEN 'Slower response time' END, CASE WHEN cost > ac * 1.2 THEN 'Higher cost' END) AS weaknesses FROM o""",
)
def win5(spark, sf):
    return ranking.traits(model_results(spark, sf))


@query(
    "WIN6_findings",
    f"""WITH {MODELS}, q AS (SELECT *, round({QUALITY}, 9) AS q FROM m), a AS (SELECT round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS reliability, round(var_pop(q) FILTER (success), 6) AS quality_variance FROM q)
    SELECT (SELECT model FROM q WHERE success ORDER BY q DESC, ordinal DESC LIMIT 1) AS best_quality, (SELECT model FROM q WHERE success ORDER BY latency_ms, ordinal LIMIT 1) AS fastest,
      (SELECT model FROM q WHERE success AND cost > 0 ORDER BY cost, ordinal LIMIT 1) AS cheapest, reliability, quality_variance, quality_variance > 0.1 AS divergent FROM a""",
)
def win6(spark, sf):
    return ranking.findings(model_results(spark, sf))


@query(
    "WIN7_recommendations",
    SCORED
    + """ SELECT 'best_overall' AS kind, (SELECT model FROM rk WHERE rank = 1) AS model, 0.9::DOUBLE AS confidence
    UNION ALL SELECT 'best_for_quality', (SELECT model FROM rk ORDER BY round(quality, 9) DESC, rank DESC LIMIT 1), 0.85::DOUBLE
    UNION ALL SELECT 'best_for_speed', (SELECT model FROM rk ORDER BY round(performance, 9) DESC, rank DESC LIMIT 1), 0.85::DOUBLE
    UNION ALL SELECT 'best_for_cost', (SELECT model FROM rk ORDER BY round(cost_efficiency, 9) DESC, rank DESC LIMIT 1), 0.85::DOUBLE""",
)
def win7(spark, sf):
    return ranking.recommendations(model_results(spark, sf))


@query("JN9_comparison_matrix", SCORED + " SELECT a.provider, a.model AS model_a, b.model AS model_b, round(CASE WHEN a.model = b.model THEN 0.0 ELSE a.quality - b.quality END, 6) AS difference FROM o a JOIN o b ON a.provider = b.provider")
def jn9(spark, sf):
    """A brand's models are one comparison."""
    return ranking.comparison_matrix(model_results(spark, sf), "provider")


def profiles(spark, sf):
    """Two parts in three have a profile."""
    part = table(spark, sf, "part").where("p_partkey % 3 <> 0")
    strengths = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("coding"))).otherwise(F.array(F.lit("reasoning")))
    return part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("model"), (F.col("p_size") / 50.0).alias("quality"), F.floor("p_retailprice").cast("long").alias("latency_ms"),
        (F.col("p_retailprice") / 100000.0).alias("cost_per_1k"), (F.col("p_size") * 1000).cast("long").alias("context"), strengths.alias("strengths"),
    )


def candidates(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("model"))


PROFILED = """WITH p AS (SELECT p_partkey AS ordinal, 'part-' || p_partkey AS model, p_partkey % 3 <> 0 AS has_profile, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50.0 END AS quality,
  CASE WHEN p_partkey % 3 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS latency_ms, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice / 100000.0 END AS cost_per_1k, p_size * 1000 AS context, p_size % 2 = 0 AS coder FROM part)"""


@query("FLT3_model_constraints", PROFILED + " SELECT model, has_profile FROM p WHERE NOT has_profile OR (quality >= 0.5 AND latency_ms <= 1400 AND context >= 8000 AND cost_per_1k * 0.1 <= 0.0015)")
def flt3(spark, sf):
    found = ranking.with_profiles(candidates(spark, sf), profiles(spark, sf)).where(ranking.admissible(0.5, 1400, 8000, 0.0015))
    return found.select("model", "has_profile")


@query("JN3_profile_defaults", PROFILED + " SELECT model, coalesce(quality, 0.7) AS quality, coalesce(latency_ms, 1000) AS latency_ms, coalesce(cost_per_1k, 0.001) AS cost_per_1k FROM p")
def jn3(spark, sf):
    d = ranking.DEFAULTS
    found = ranking.with_profiles(candidates(spark, sf), profiles(spark, sf))
    return found.select("model", F.coalesce("quality", F.lit(d["quality"])).alias("quality"), F.coalesce("latency_ms", F.lit(d["latency_ms"]).cast("long")).alias("latency_ms"), F.coalesce("cost_per_1k", F.lit(d["cost_per_1k"])).alias("cost_per_1k"))


@query(
    "WIN9_router",
    PROFILED
    + """, s AS (SELECT ordinal, model, round(CASE WHEN NOT has_profile THEN 0.5 ELSE (quality * 0.5 + 1000.0 / greatest(latency_ms, 1) * 0.25 + quality / greatest(cost_per_1k, 0.0001) * 0.25) * CASE WHEN coder THEN 1.2 ELSE 1.0 END END, 9) AS score FROM p
       WHERE NOT has_profile OR quality >= 0.5)
    SELECT CAST(place AS INT) AS place, model, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, ordinal) AS place FROM s) WHERE place <= 4""",
)
def win9(spark, sf):
    return ranking.route(candidates(spark, sf), profiles(spark, sf), "balanced", "coding", min_quality=0.5)


@query(
    "WIN10_route_scores",
    PROFILED
    + """ SELECT model, round(CASE WHEN has_profile THEN quality ELSE 0.7 END, 9) AS quality_score, round(CASE WHEN has_profile THEN quality / greatest(cost_per_1k, 0.0001) ELSE 0.5 END, 9) AS cost_score,
      round(CASE WHEN has_profile THEN 1000.0 / greatest(latency_ms, 1) ELSE 0.5 END, 9) AS latency_score FROM p""",
)
def win10(spark, sf):
    found = ranking.with_profiles(candidates(spark, sf), profiles(spark, sf))
    return found.select("model", *[F.round(ranking.route_score(s), 9).alias(f"{s}_score") for s in ("quality", "cost", "latency")])


@query(
    "WIN11_profile_ewma",
    """WITH RECURSIVE o AS (SELECT user_id AS model, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT model, n, CAST(value / 500.0 AS DOUBLE) AS q, CAST(floor(value * 10) AS DOUBLE) AS l FROM o WHERE n = 1
      UNION ALL SELECT f.model, o.n, f.q * (1 - 0.1::DOUBLE) + o.value / 500.0 * 0.1::DOUBLE, floor(f.l * (1 - 0.1::DOUBLE) + floor(o.value * 10) * 0.1::DOUBLE) FROM f JOIN o ON o.model = f.model AND o.n = f.n + 1)
    SELECT model, round(q, 6) AS quality, CAST(l AS BIGINT) AS latency_ms, n AS samples FROM f QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC) = 1""",
)
def win11(spark, sf):
    """A user's events are a model's observations."""
    seen = table(spark, sf, "events").select(F.col("user_id").alias("model"), "ts", F.col("event_id").alias("tie"), (F.col("value") / 500.0).alias("quality"), F.floor(F.col("value") * 10).alias("latency"))
    return ranking.smoothed_profiles(seen)


@query(
    "WIN12_cost_recommendation",
    f"""WITH {RESULTS}, s AS (SELECT provider || '/' || model AS model, count(*) FILTER (status = 'success') / count(*)::DOUBLE AS quality, round(sum(cost) / count(*), 9) AS cost FROM rc GROUP BY provider, model),
    g AS (SELECT * FROM s WHERE quality >= 0.84), a AS (SELECT * FROM g ORDER BY cost, model LIMIT 1), c AS (SELECT * FROM g ORDER BY cost DESC, model DESC LIMIT 1)
    SELECT a.model AS recommended, c.model AS current, round((c.cost - a.cost) * 30 * 24 * 100, 6) AS monthly_savings, round((c.cost - a.cost) * 30 * 24 * 100 * 12, 6) AS annual_savings,
      round(a.quality - c.quality, 6) AS quality_delta, round(0.9 * (1 - abs(a.quality - c.quality) / c.quality), 6) AS confidence FROM a, c""",
)
def win12(spark, sf):
    s = results(spark, sf).groupBy(F.concat_ws("/", "provider", "model").alias("model")).agg(
        (F.count_if(F.col("status") == "success") / F.count("*")).alias("quality"), F.round(F.sum(benchmark.cost()) / F.count("*"), 9).alias("cost")
    )
    return ranking.cheaper_model(s, 0.84)


def requests(spark, sf):
    """A test is a stress request at the level of its quantity; higher levels fail more."""
    r = results(spark, sf)
    ok = F.pmod(F.col("run_key") * 7, F.lit(50)) >= F.col("level") - 10
    mode = F.element_at(F.array(F.lit("timeout"), F.lit("rate_limited"), F.lit(None).cast("string"), F.lit("server_error")), (F.col("part_key") % 4 + 1).cast("int"))
    return r.select(
        F.col("category").alias("scenario"), "provider", "model", "level", ok.alias("success"), F.when(~ok, mode).alias("failure_mode"), F.col("duration_ms").alias("latency_ms"), "ts",
        F.concat_ws("-", "run_key", "duration_ms", "level", "part_key").alias("tie"),
    )


REQUESTS = f"""WITH {RESULTS}, q AS (SELECT category AS scenario, provider, model, level, (run_key * 7) % 50 >= level - 10 AS success,
  CASE WHEN NOT ((run_key * 7) % 50 >= level - 10) THEN ['timeout', 'rate_limited', NULL, 'server_error'][CAST(part_key % 4 + 1 AS INT)] END AS failure_mode, duration_ms AS latency_ms, ts,
  concat_ws('-', run_key, duration_ms, level, part_key) AS tie FROM r)"""
BREAKS = """, lv AS (SELECT scenario, provider, model, level, avg(CAST(NOT success AS DOUBLE)) AS rate FROM q GROUP BY ALL),
  b AS (SELECT *, lag(rate) OVER w AS before, row_number() OVER w AS place FROM lv WINDOW w AS (PARTITION BY scenario, provider, model ORDER BY level)),
  th AS (SELECT scenario, provider, model, min(level) FILTER (rate > 0.5) AS threshold FROM b GROUP BY ALL HAVING min(level) FILTER (rate > 0.5) IS NOT NULL),
  br AS (SELECT scenario, provider, model, threshold, round(max(rate) FILTER (level = threshold), 6) AS failure_rate, min(level) FILTER (rate > 0) AS first_failure_at,
    CASE WHEN max(place) = 1 THEN 'immediate' WHEN count(*) FILTER (rate < before) = 0 AND max(place) > 2 THEN 'gradual' WHEN max(rate - before) FILTER (level = threshold) > 0.3 THEN 'cliff' ELSE 'oscillating' END AS pattern
    FROM b JOIN th USING (scenario, provider, model) WHERE level <= threshold GROUP BY ALL)"""
RECOVERY = """, ff AS (SELECT scenario, provider, model, min((ts, tie)) FILTER (NOT success) AS failed FROM q GROUP BY ALL),
  bk AS (SELECT scenario, provider, model, min((ts, tie)) FILTER (success AND (ts, tie) > failed) AS back FROM q JOIN ff USING (scenario, provider, model) GROUP BY ALL),
  rec AS (SELECT scenario, provider, model, CAST(CASE WHEN any_value(back) IS NOT NULL THEN epoch_ms(any_value(back)[1]) - epoch_ms(any_value(failed)[1]) END AS BIGINT) AS recovery_ms,
    round(CASE WHEN any_value(back) IS NULL THEN 1.0 ELSE avg(CAST(success AS DOUBLE)) FILTER ((ts, tie) >= back) END, 6) AS stability
    FROM q JOIN ff USING (scenario, provider, model) JOIN bk USING (scenario, provider, model) GROUP BY ALL)"""


@query("AGG8_failure_modes", REQUESTS + " SELECT scenario, coalesce(failure_mode, 'unknown') AS mode, count(*) AS n, min(ts) AS first_at, round(count(*) / sum(count(*)) OVER (PARTITION BY scenario), 6) AS share FROM q WHERE NOT success GROUP BY scenario, coalesce(failure_mode, 'unknown')")
def agg8(spark, sf):
    return stress.failure_modes(requests(spark, sf))


@query(
    "AGG9_scenario_stats",
    REQUESTS
    + """, s AS (SELECT scenario, provider, model, count(*) AS requests, count(*) FILTER (success) AS succeeded, round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS success_rate,
      round(coalesce(avg(latency_ms) FILTER (success), 0.0), 6) AS latency_mean, list_sort(list(latency_ms) FILTER (success)) AS l FROM q GROUP BY ALL)
    SELECT scenario, provider, model, requests, succeeded, success_rate, latency_mean, coalesce(l[greatest(1, CAST(ceil(0.5 * succeeded) AS BIGINT))], 0) AS p50, coalesce(l[greatest(1, CAST(ceil(0.95 * succeeded) AS BIGINT))], 0) AS p95,
      coalesce(l[greatest(1, CAST(ceil(0.99 * succeeded) AS BIGINT))], 0) AS p99, coalesce(l[greatest(1, CAST(ceil(0.95 * succeeded) AS BIGINT))], 0) <= 95000 AS latency_kept, success_rate >= 0.7 AS success_kept FROM s""",
)
def agg9(spark, sf):
    return stress.scenario_stats(requests(spark, sf), 95_000, 0.7)


@query("WIN15_breaking_points", REQUESTS + BREAKS + " SELECT * FROM br")
def win15(spark, sf):
    return stress.breaking_points(requests(spark, sf))


@query("WIN17_recovery", REQUESTS + RECOVERY + " SELECT * FROM rec")
def win17(spark, sf):
    return stress.recovery(requests(spark, sf))


@query(
    "AGG10_robustness",
    REQUESTS + BREAKS + RECOVERY
    + """, rt AS (SELECT scenario, provider, model, avg(CAST(success AS DOUBLE)) AS rate FROM q GROUP BY ALL),
      a AS (SELECT provider, model, avg(rate) AS rate, count(first_failure_at) AS breaks, avg(stability) AS stability, min(first_failure_at) - 1 AS mc FROM rt LEFT JOIN br USING (scenario, provider, model) JOIN rec USING (scenario, provider, model) GROUP BY ALL),
      cm AS (SELECT provider, model, mode AS common_failure FROM (SELECT provider, model, coalesce(failure_mode, 'unknown') AS mode, count(*) AS n FROM q WHERE NOT success GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY provider, model ORDER BY n DESC, mode) = 1)
    SELECT provider, model, round(rate * 0.5 + CASE WHEN breaks > 0 THEN 0.5 ELSE 1.0 END * 0.25 + stability * 0.25, 6) AS robustness, CAST(mc AS INT) AS max_concurrency, CAST(CASE WHEN mc <> 0 THEN floor(mc * 0.8) END AS BIGINT) AS recommended_concurrency,
      CASE WHEN rate < 0.5 THEN 'severe' WHEN rate < 0.7 THEN 'moderate' WHEN rate < 0.9 THEN 'mild' ELSE 'none' END AS severity, common_failure FROM a LEFT JOIN cm USING (provider, model)""",
)
def agg10(spark, sf):
    return stress.robustness(requests(spark, sf))
