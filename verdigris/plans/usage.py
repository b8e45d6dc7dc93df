"""Queries and SQL: costs, confidence, cluster health, prompt sensitivity, metrics in result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.storage import stored
from verdigris.operators import confidence, consistency, costs, metrics, records, sensitivity
from verdigris.operators import inference as tests
from verdigris.operators import stress as stressed
from verdigris.plans import inference as P
from verdigris.plans import texts as T
from verdigris.plans.fixtures import RESULTS, results, table, turns
from verdigris.plans.records import AS_OF, WORKERS, as_of, workers

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# costs


def null_or(x) -> str:
    return "NULL" if x is None else f"'{x}'"


PRICE_VALUES = ", ".join(f"('{s}', {null_or(p)}, '{m}', '{c}', {a}::DOUBLE, {b}::DOUBLE, {u}, {k})" for k, (s, p, m, c, a, b, u) in enumerate(costs.PRICES))
PRICES = f"prices(source, provider, model, compared, per_prompt, per_completion, unit, place) AS (VALUES {PRICE_VALUES})"
ASKED = (("openai", "gpt-4"), ("openai", "gpt-4-turbo-preview"), ("openai", "gpt-3.5-turbo-0125"), ("openai", "o1"), ("anthropic", "claude-3-opus-20240229"), ("anthropic", "claude-3-haiku"), ("mistral", "gpt-4o"), ("none", "none"))
ASKED_VALUES = ", ".join(f"('{p}', '{m}')" for p, m in ASKED)


@query("MTH2_prices", f"WITH {PRICES} SELECT * FROM prices")
def mth2(spark, sf):
    return costs.prices(spark)


@query(
    "MTH2_priced_requests",
    f"""WITH {PRICES}, asked(provider, model) AS (VALUES {ASKED_VALUES}), fit AS (
      SELECT s.source, a.provider, a.model, arg_min(p.per_prompt / p.unit, p.place) AS x, arg_min(p.per_completion / p.unit, p.place) AS y
      FROM asked a CROSS JOIN (SELECT DISTINCT source FROM prices) s LEFT JOIN prices p ON p.source = s.source AND (p.provider IS NULL OR p.provider = a.provider)
        AND (p.compared = 'any' OR p.compared = 'is' AND p.model = a.model OR p.compared = 'has' AND contains(a.model, p.model)) GROUP BY ALL)
    SELECT source, provider, model, round(coalesce(1000 * x + 500 * y, 0.0), 9) AS price FROM fit""",
)
def mth2b(spark, sf):
    """A request of 1,000 prompt and 500 completion tokens, by every source's table."""
    asked = spark.createDataFrame(list(ASKED), "provider string, model string")
    price = lambda s: F.struct(F.lit(s).alias("source"), F.round(costs.request_price(s, F.col("provider"), F.col("model"), F.lit(1000.0), F.lit(500.0)), 9).alias("price"))
    return asked.select("provider", "model", F.inline(F.array(*map(price, dict.fromkeys(r[0] for r in costs.PRICES)))))


JUDGED = "CASE l_linenumber WHEN 1 THEN 'gpt-4' WHEN 2 THEN 'claude-3-haiku-20240307' ELSE 'model-' || l_linenumber END"


@query(
    "JN4_priced_models",
    f"WITH {PRICES}, m AS (SELECT DISTINCT {JUDGED} AS model FROM lineitem) SELECT m.model, round(100 / 1000.0 * coalesce(per_prompt, 0.01) + 50 / 1000.0 * coalesce(per_completion, 0.03), 9) AS cost FROM m LEFT JOIN prices p ON p.model = m.model AND p.source = 'judge'",
)
def jn4(spark, sf):
    from verdigris.operators import ranking

    line = F.col("l_linenumber")
    name = F.when(line == 1, "gpt-4").when(line == 2, "claude-3-haiku-20240307").otherwise(F.concat(F.lit("model-"), line.cast("string")))
    return ranking.price_per_request(table(spark, sf, "lineitem").select(name.alias("model")).distinct(), costs.prices(spark).where("source = 'judge'").select("model", "per_prompt", "per_completion"))


def history(spark, sf):
    """Forty benchmarks of tests with long prompts: those of one benchmark end alike."""
    return results(spark, sf).withColumns({"benchmark": F.pmod("run_key", F.lit(40)), "prompt_tokens": F.col("prompt_tokens") * 3, "completion_tokens": F.col("completion_tokens") * 3})


USAGE = f"""WITH {RESULTS}, h AS (SELECT run_key % 40 AS benchmark, status, 3 * prompt_tokens AS p, 3 * completion_tokens AS c FROM r),
  u AS (SELECT benchmark, count(*) AS n, coalesce(sum(p), 0) / count(*)::DOUBLE AS p, coalesce(sum(c), 0) / count(*)::DOUBLE AS c, coalesce(sum(p / 1000.0 * 0.03 + c / 1000.0 * 0.06), 0) AS cost, count(*) FILTER (status = 'success') / count(*)::DOUBLE AS rate FROM h GROUP BY benchmark)"""


@query(
    "MTH3_expensive_patterns",
    USAGE
    + """ SELECT benchmark, pattern, round(cost / n, 6) AS average_cost, n AS frequency, round(saved, 4) AS potential_savings FROM (
      SELECT *, 'long_prompts' AS pattern, (p - 800) / 1000 * 0.03 * n AS saved FROM u WHERE p > 1000 UNION ALL SELECT *, 'verbose_responses', (c - 300) / 1000 * 0.06 * n FROM u WHERE c > 500
      UNION ALL SELECT *, 'expensive_model', cost / n * 0.5 * n FROM u WHERE cost / n > 0.05 AND rate > 0.98)""",
)
def mth3(spark, sf):
    found = costs.expensive_patterns(history(spark, sf), ["benchmark"])
    return found.select("benchmark", "pattern", F.round("average_cost", 6).alias("average_cost"), "frequency", F.round("potential_savings", 4).alias("potential_savings"))


@query(
    "MTH4_suggestions",
    USAGE
    + """ SELECT benchmark, title, effort, round(saving, 4) AS estimated_savings FROM (
      SELECT benchmark, 'Compress Long Prompts' AS title, 'medium' AS effort, (p - 700) / 1000 * 0.03 * n AS saving FROM u WHERE p > 1000 UNION ALL SELECT benchmark, 'Set Response Length Limits', 'low', (c - 300) / 1000 * 0.06 * n FROM u WHERE c > 500
      UNION ALL SELECT benchmark, 'Use Batch Processing', 'high', cost * 0.1 FROM u WHERE n > 100 UNION ALL SELECT benchmark, 'Optimize Temperature Settings', 'low', 0.0 FROM u WHERE rate > 0.95)""",
)
def mth4(spark, sf):
    return costs.suggestions(history(spark, sf), ["benchmark"]).select("benchmark", "title", "effort", F.round("estimated_savings", 4).alias("estimated_savings"))


MODELS_IN_USE = ("gpt-4", "gpt-4-turbo", "gpt-3.5-turbo", "claude-3-opus", "claude-3-haiku", "a-model-without-a-price")


@query(
    "MTH5_savings",
    f"""WITH {PRICES}, m(model) AS (VALUES {', '.join(f"('{m}')" for m in MODELS_IN_USE)}), o AS (SELECT m.model, per_prompt, per_completion FROM m LEFT JOIN prices p ON p.model = m.model AND p.source = 'optimizer')
    SELECT a.model AS current, b.model AS recommended, round((0.1 * coalesce(a.per_prompt, 0.03) + 0.05 * coalesce(a.per_completion, 0.06) - 0.1 * coalesce(b.per_prompt, 0.01) - 0.05 * coalesce(b.per_completion, 0.02)) * 100000, 4) AS monthly FROM o a, o b""",
)
def mth5(spark, sf):
    """A stated handful of models, each against each, at 100,000 requests a month."""
    pairs = spark.createDataFrame([(a, b) for a in MODELS_IN_USE for b in MODELS_IN_USE], "current string, recommended string")
    return pairs.withColumn("monthly", F.round(costs.savings(F.col("current"), F.col("recommended"), F.lit(100_000)), 4))


# confidence


@query(
    "STA16_confidence",
    f"""WITH {RESULTS}, s AS (SELECT provider, model, count(*) AS n, count(*) FILTER (status = 'success') / count(*)::DOUBLE AS rate, avg(duration_ms) FILTER (status = 'success') AS mean, stddev_pop(duration_ms) FILTER (status = 'success') AS sd FROM r GROUP BY ALL)
    SELECT provider, model, round(0.4 * rate + 0.2 * greatest(0.0, 1 - coalesce(sd / mean, 1)) + 0.2 * 0.8 + 0.2 * least(1.0, log10(n + 1) / 2), 6) AS confidence FROM s""",
)
def sta16(spark, sf):
    ok = F.col("status") == "success"
    latency = F.when(ok, F.col("duration_ms"))
    stats = results(spark, sf).groupBy("provider", "model").agg(F.avg(ok.cast("double")).alias("rate"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(latency), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    return stats.select("provider", "model", F.round(confidence.of_benchmark(F.col("rate"), F.col("mean"), F.col("sd"), F.col("n")), 6).alias("confidence"))


@query(
    "STA16_regression_confidence",
    P.REGRESSIONS
    + """ SELECT provider, model, round(0.3 * least(1.0, log10(max(n1) + max(n2) + 1) / 3) + 0.3 * avg(1 - p) + 0.2 * avg(least(1.0, abs(effect) / 2)) + 0.15 * least(1.0, coalesce(avg(greatest(0.0, 1 - sd1 / abs(mean1))) FILTER (mean1 <> 0), 0.5)) + 0.05 * least(1.0, count(*) / 4.0), 6) AS confidence
    FROM (SELECT *, """ + P.POOLED + """ AS effect FROM h) GROUP BY provider, model""",
)
def sta16b(spark, sf):
    return confidence.of_regressions(tests.regressions(P.runs(spark, sf), ["provider", "model"]), ["provider", "model"])


@query(
    "STA16_consistency_confidence",
    T.AVERAGE
    + """, w AS (SELECT conv_id AS group_id, count(*) AS outputs, avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS tokens FROM conversations GROUP BY 1),
    sc AS (SELECT group_id, avg(similarity) AS score FROM av GROUP BY 1), g AS (SELECT * FROM sc JOIN w USING (group_id))
    SELECT round(0.2 * least(1.0, log10(count(*) + 1) / 2) + 0.25 * greatest(0.0, least(1.0, (avg(outputs) - 2) / 8)) + 0.2 * 0.85 + 0.15 * least(1.0, avg(tokens) / 200) + 0.2 * greatest(0.0, 1 - stddev_pop(score) * 2), 6) AS confidence FROM g""",
)
def sta16c(spark, sf):
    from verdigris.functions import text as X

    score = consistency.average_similarity(turns(spark, sf)).groupBy("group_id").agg(F.avg("similarity").alias("score"))
    sizes = turns(spark, sf).groupBy("group_id").agg(F.count("*").alias("outputs"), F.avg(F.size(X.words_by_space(F.col("content")))).alias("tokens"))
    return confidence.of_consistency(score.join(sizes, "group_id"), "jaccard_tokens")


@query(
    "STA16_stress_confidence",
    P.REQUESTS
    + P.BREAKS
    + P.RECOVERY
    + """, x AS (SELECT scenario, provider, model, count(*) AS n, count(*) FILTER (success) / count(*)::DOUBLE AS rate FROM q GROUP BY ALL), y AS (SELECT x.*, br.pattern IS NOT NULL AS breaks, rec.recovery_ms IS NOT NULL AS recovered FROM x LEFT JOIN br USING (scenario, provider, model) LEFT JOIN rec USING (scenario, provider, model))
    SELECT round(0.25 * least(1.0, log10(sum(n) + 1) / 3) + 0.2 * least(1.0, count(DISTINCT scenario) / 5.0) + 0.25 * greatest(0.0, 1 - stddev_pop(rate)) + 0.15 * CASE WHEN bool_or(breaks) THEN 1 ELSE 0.5 END + 0.15 * CASE WHEN bool_or(recovered) THEN 1 ELSE 0.5 END, 6) AS confidence FROM y""",
)
def sta16d(spark, sf):
    """A category is a type of test."""
    r = stored(P.requests(spark, sf).select(*stressed.SCENARIO, "level", "success", "ts", "tie"))
    s = r.groupBy("scenario", "provider", "model").agg(F.count("*").alias("requests"), F.avg(F.col("success").cast("double")).alias("success_rate"))
    broken = stressed.breaking_points(r).select("scenario", "provider", "model", F.lit(True).alias("b"))
    back = stressed.recovery(r, True).select("scenario", "provider", "model", F.col("recovery_ms").isNotNull().alias("recovered"))
    s = s.join(broken, ["scenario", "provider", "model"], "left").join(back, ["scenario", "provider", "model"], "left")
    s = s.withColumns({"breaks": F.coalesce("b", F.lit(False)), "test_type": F.col("scenario")})
    return confidence.of_stress(s)


# cluster


@query(
    "AGG22_cluster_metrics",
    WORKERS
    + """ SELECT count(*) AS workers, count(*) FILTER (status IN ('idle', 'busy')) AS active, count(*) FILTER (status = 'idle') AS idle, count(*) FILTER (status = 'busy') AS busy, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'offline') AS offline,
    CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(tasks) AS BIGINT) AS tasks, CAST(greatest(0, sum(capacity) - sum(tasks)) AS BIGINT) AS free, round(sum(tasks) / sum(capacity)::DOUBLE, 6) AS load FROM w""",
)
def agg22(spark, sf):
    return records.cluster_metrics(workers(spark, sf))


@query(
    "AGG23_cluster_health",
    WORKERS
    + """, s AS (SELECT id % 25 AS cluster, count(*) AS n, count(*) FILTER (up AND silent < 60) AS healthy, count(*) FILTER (up AND silent >= 60 AND silent < 90) AS degraded, round(CASE WHEN sum(capacity) > 0 THEN sum(tasks) / sum(capacity)::DOUBLE ELSE 0 END, 6) AS load
      FROM (SELECT *, status = 'idle' OR status = 'busy' AS up FROM w) GROUP BY 1)
    SELECT cluster, healthy, degraded, n - healthy - degraded AS unhealthy, load, CASE WHEN n > healthy + degraded THEN 'unhealthy' WHEN degraded > 0 OR load > 0.9 THEN 'degraded' ELSE 'healthy' END AS status FROM s""",
)
def agg23(spark, sf):
    w = workers(spark, sf).withColumn("cluster", F.col("id") % 25)
    return records.cluster_health(w, as_of(), 60, 90, ("cluster",))


# prompt sensitivity


def perturbation_runs(spark, sf):
    """Later turns of a conversation are runs of perturbations of its first, of two kinds by turns."""
    t = turns(spark, sf).where("ordinal > 0")
    n = F.char_length("content")
    return t.select("group_id", (F.col("ordinal") % 2).alias("kind"), "ordinal", (F.col("ordinal") % 5 != 3).alias("success"), "content", (n * 2).alias("latency_ms"), F.floor(n / 4).alias("tokens"))


SENSITIVITY = f"""WITH u AS (SELECT conv_id AS group_id, turn % 2 AS kind, turn AS o, turn % 5 <> 3 AS ok, {T.SPACE.format('text')} AS w, length(text) * 2 AS latency, floor(length(text) / 4.0) AS tokens FROM conversations WHERE turn > 0),
  b AS (SELECT conv_id AS group_id, {T.SPACE.format('text')} AS w FROM conversations WHERE turn = 0),
  pv AS (SELECT a.group_id, a.kind, 1 - avg({T.jaccard_sql('a.w', 'c.w', '0.0')}) AS v FROM u a JOIN u c ON a.group_id = c.group_id AND a.kind = c.kind AND a.o < c.o WHERE a.ok AND c.ok GROUP BY ALL),
  pb AS (SELECT u.group_id, u.kind, avg({T.jaccard_sql('u.w', 'b.w', '0.0')}) AS s FROM u JOIN b USING (group_id) WHERE ok GROUP BY ALL),
  ag AS (SELECT group_id, kind, round(coalesce(any_value(v), 0.0), 6) AS response_variance, round(coalesce(any_value(s), 0.0), 6) AS similarity_to_base, round(coalesce(avg(latency) FILTER (ok), 0.0), 6) AS avg_latency, round(coalesce(var_pop(latency) FILTER (ok), 0.0), 6) AS var_latency,
    round(coalesce(avg(tokens) FILTER (ok), 0.0), 6) AS avg_tokens, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS success_rate FROM u LEFT JOIN pv USING (group_id, kind) LEFT JOIN pb USING (group_id, kind) GROUP BY group_id, kind)"""


def sensitivities(spark, sf):
    base = turns(spark, sf).where("ordinal = 0").select("group_id", "content")
    return sensitivity.aggregates(perturbation_runs(spark, sf), base, ["group_id", "kind"], ["group_id"])


@query("AGG27_prompt_sensitivity", SENSITIVITY + " SELECT * FROM ag")
def agg27(spark, sf):
    return sensitivities(spark, sf)


@query(
    "STA14_sensitivity",
    SENSITIVITY
    + """, s AS (SELECT kind, avg(response_variance) AS m, stddev_pop(response_variance) AS sd, count(*) AS n, arg_max(group_id, (response_variance, -group_id)) AS most, arg_min(group_id, (response_variance, -group_id)) AS least FROM ag GROUP BY kind)
    SELECT kind, round(m, 6) AS variance_score, most AS most_sensitive, least AS least_sensitive, round(greatest(0.0, m - 2 * sd / sqrt(n)), 6) AS low, round(least(1.0, m + 2 * sd / sqrt(n)), 6) AS high, sd < 0.2 AND n >= 3 AS significant FROM s""",
)
def sta14(spark, sf):
    """Per kind, with a conversation as a perturbation."""
    return sensitivity.overall(sensitivities(spark, sf).withColumn("place", F.col("group_id")), ["kind"], "group_id")


# metrics in files


def result_files(spark, sf):
    """An event is a file; its shape goes by its id."""
    v, k = F.floor("value").cast("string"), F.col("event_id") % 5
    made = {
        0: ('{"results":[{"duration_ms":%s},{"duration_ms":%s.5},{"tokens_used":3}],"summary":{"duration_ms":1}}', 2), 1: ('{"results":[{"other":1}],"summary":{"duration_ms":%s}}', 1),
        2: ('[{"results":[{"duration_ms":%s}]},{"name":"x"},{"results":[{"duration_ms":1%s},{"duration_ms":"7"}]}]', 2), 3: ('{"results":[{"duration_ms":"%s"}],"duration_ms":9}', 1),
    }
    text = F.format_string('{"summary":{"duration_ms":null},"results":[],"was":"%s"}', v)
    for at, (form, n) in made.items():
        text = F.when(k == at, F.format_string(form, *[v] * n)).otherwise(text)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), text.alias("json"))


@query(
    "FLT10_json_metric",
    """WITH e AS (SELECT event_id AS id, CAST(floor(value) AS BIGINT) AS v, event_id % 5 AS k FROM events), f AS (SELECT id, CASE k WHEN 0 THEN [v, v + 0.5] WHEN 1 THEN [v::DOUBLE] WHEN 2 THEN [v::DOUBLE, CAST('1' || v AS DOUBLE)] END AS l FROM e)
    SELECT id, CAST(unnest(range(0, len(l))) AS INT) AS place, CAST(unnest(l) AS DOUBLE) AS value FROM f""",
)
def flt10(spark, sf):
    found = metrics.metric_values(result_files(spark, sf), "latency")
    return found.select("id", F.posexplode("values").alias("place", "value"))
