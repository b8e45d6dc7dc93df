"""Queries and SQL: summaries, fleets, breakdowns, filters and set operations over test results."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import benchmark as B
from verdigris.plans.fixtures import RESULTS, results

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def summary_sql(keys: str) -> str:
    by = f"GROUP BY {keys}" if keys else ""
    pick = lambda p: f"list_sort(list(duration_ms))[CAST(ceil({p} * (count(*) - 1)) AS BIGINT) + 1]"
    return f"""
    SELECT {keys + "," if keys else ""} count(*) AS total, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failure') AS failed,
      count(*) FILTER (status = 'timeout') AS timeout, count(*) FILTER (status = 'skipped') AS skipped, round(avg(duration_ms), 6) AS avg_duration_ms,
      min(duration_ms) AS min_duration_ms, max(duration_ms) AS max_duration_ms, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens,
      round(coalesce(sum(cost), 0.0), 6) AS total_cost, round(count(*) FILTER (status = 'success') / count(*)::DOUBLE, 6) AS success_rate,
      round(coalesce(sum(tokens), 0) / count(*) FILTER (status = 'success')::DOUBLE, 6) AS avg_tokens_per_request,
      {pick(0.5)} AS p50_duration_ms, {pick(0.95)} AS p95_duration_ms, {pick(0.99)} AS p99_duration_ms
    FROM rc {by}"""


@query("AGG1_summary", f"WITH {RESULTS} {summary_sql('provider')}")
def agg1(spark, sf):
    return B.summary(results(spark, sf), ["provider"])


@query(
    "AGG2_fleet_summary",
    f"""WITH {RESULTS}, s AS ({summary_sql('')}), n AS (SELECT count(DISTINCT repository) AS repositories FROM rc)
    SELECT repositories, total, succeeded, failed, timeout, skipped, success_rate, avg_duration_ms, min_duration_ms, max_duration_ms, p50_duration_ms, p95_duration_ms,
      p99_duration_ms, total_tokens, total_cost, round(total_cost / repositories, 6) AS avg_cost_per_repository, round(total / repositories::DOUBLE, 6) AS avg_tests_per_repository
    FROM s, n""",
)
def agg2(spark, sf):
    return B.fleet_summary(results(spark, sf))


def breakdown_sql(key: str) -> str:
    return f"""WITH {RESULTS} SELECT {key}, count(DISTINCT repository) AS repositories, count(*) AS total, count(*) FILTER (status = 'success') AS succeeded,
      count(*) FILTER (status = 'failure') AS failed, round(avg(duration_ms), 6) AS avg_duration_ms, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens,
      round(coalesce(sum(cost), 0.0), 6) AS total_cost, round(count(*) FILTER (status = 'success') / count(*)::DOUBLE, 6) AS success_rate
      FROM rc WHERE {key} IS NOT NULL GROUP BY {key}"""


@query("AGG3_provider_breakdown", breakdown_sql("provider"))
def agg3(spark, sf):
    return B.breakdown(results(spark, sf), "provider")


@query("AGG4_category_breakdown", breakdown_sql("category"))
def agg4(spark, sf):
    return B.breakdown(results(spark, sf), "category")


RATES = "rates AS (SELECT repository, round(count(*) FILTER (status = 'success') / count(*)::DOUBLE, 6) AS success_rate, count(*) AS total FROM r GROUP BY repository)"


@query(
    "AGG5_best_worst_repository",
    f"""WITH {RESULTS}, {RATES}
    (SELECT 'best' AS kind, repository, success_rate FROM rates ORDER BY success_rate DESC, repository DESC LIMIT 1)
    UNION ALL (SELECT 'worst', repository, success_rate FROM rates ORDER BY success_rate, repository LIMIT 1)""",
)
def agg5(spark, sf):
    return B.best_and_worst(results(spark, sf))


@query("FLT5_failing_repositories", f"WITH {RESULTS}, {RATES} SELECT * FROM rates WHERE success_rate < 0.85")
def flt5(spark, sf):
    return B.failing(results(spark, sf), 0.85)


@query(
    "AGG6_model_stats",
    f"""WITH {RESULTS}, s AS (SELECT *, status = 'success' AS ok FROM rc)
    SELECT provider, model, count(*) AS executions, count(*) FILTER (ok) AS succeeded, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS success_rate,
      round(coalesce(avg(duration_ms) FILTER (ok), 0.0), 6) AS latency_mean, round(coalesce(stddev_pop(duration_ms) FILTER (ok), 0.0), 6) AS latency_sd,
      coalesce(min(duration_ms) FILTER (ok), 0) AS latency_min, coalesce(max(duration_ms) FILTER (ok), 0) AS latency_max,
      CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, round(coalesce(sum(cost), 0.0), 6) AS total_cost,
      round(coalesce(avg(completion_tokens / (duration_ms / 1000.0)) FILTER (ok AND duration_ms > 0), 0.0), 6) AS tokens_per_second,
      coalesce(list_sort(list(duration_ms) FILTER (ok))[greatest(1, CAST(ceil(0.5 * count(*) FILTER (ok)) AS BIGINT))], 0) AS latency_p50,
      coalesce(list_sort(list(duration_ms) FILTER (ok))[greatest(1, CAST(ceil(0.95 * count(*) FILTER (ok)) AS BIGINT))], 0) AS latency_p95,
      coalesce(list_sort(list(duration_ms) FILTER (ok))[greatest(1, CAST(ceil(0.99 * count(*) FILTER (ok)) AS BIGINT))], 0) AS latency_p99
    FROM s GROUP BY provider, model""",
)
def agg6(spark, sf):
    return B.model_stats(results(spark, sf))


@query(
    "AGG7_analysis",
    f"""WITH {RESULTS} SELECT category, count(duration_ms) AS n, round(avg(duration_ms), 6) AS mean, round(stddev_pop(duration_ms), 6) AS sd, min(duration_ms) AS min, max(duration_ms) AS max,
      (list_sort(list(duration_ms))[(count(*) + 1) // 2] + list_sort(list(duration_ms))[count(*) // 2 + 1]) / 2.0 AS median,
      list_sort(list(duration_ms))[least(CAST(floor(count(*) * 0.95) AS BIGINT) + 1, count(*))] AS p95
    FROM r GROUP BY category""",
)
def agg7(spark, sf):
    return B.analysis(results(spark, sf), ["category"], "duration_ms")


@query(
    "AGG_fleet_grouping_sets",
    f"""WITH {RESULTS} SELECT provider, category, CAST(grouping(provider, category) AS BIGINT) AS level, count(*) AS total, count(*) FILTER (status = 'success') AS succeeded,
      round(avg(duration_ms), 6) AS avg_duration_ms FROM r GROUP BY GROUPING SETS ((), (provider), (category))""",
)
def agg_sets(spark, sf):
    return B.rollup(results(spark, sf))


@query("FLT1_status_filter", f"WITH {RESULTS} SELECT status, count(*) AS n FROM r WHERE status IN ('failure', 'timeout') GROUP BY status")
def flt1(spark, sf):
    return results(spark, sf).where(F.col("status").isin("failure", "timeout")).groupBy("status").agg(F.count("*").alias("n"))


@query("FLT2_category_filter", f"WITH {RESULTS} SELECT test_id, provider, duration_ms FROM r WHERE category = '1-URGENT'")
def flt2(spark, sf):
    return results(spark, sf).where(F.col("category") == "1-URGENT").select("test_id", "provider", "duration_ms")


@query("FLT4_quality_threshold", "SELECT p_partkey, p_size / 50.0 AS quality FROM part WHERE p_size / 50.0 >= 0.95")
def flt4(spark, sf):
    from verdigris.plans.fixtures import table

    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("quality")).where("quality >= 0.95")


@query("FLT9_metric_projection", f"WITH {RESULTS} SELECT test_id, round(cost, 9) AS value FROM rc WHERE cost IS NOT NULL")
def flt9(spark, sf):
    return B.metric(results(spark, sf), "cost").withColumn("value", F.round("value", 9))


@query(
    "MTH6_latency_histogram",
    f"""WITH {RESULTS}, ok AS (SELECT duration_ms FROM r WHERE status = 'success'), e AS (SELECT min(duration_ms) AS lo, (max(duration_ms) - min(duration_ms) + 1) // 20 AS width FROM ok),
      c AS (SELECT CASE WHEN width = 0 THEN 0 ELSE least((duration_ms - lo) // width, 19) END AS bin, count(*) AS n FROM ok, e GROUP BY 1)
    SELECT CAST(b AS INT) AS bin, lo + b * width AS from_ms, coalesce(n, 0) AS n FROM range(20) t(b), e LEFT JOIN c ON c.bin = b""",
)
def mth6(spark, sf):
    return B.histogram(results(spark, sf), 20)


@query(
    "MTH7_status_share",
    f"WITH {RESULTS} SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY status",
)
def mth7(spark, sf):
    from pyspark.sql import Window

    counts = results(spark, sf).groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query(
    "WIN24_trend",
    f"WITH {RESULTS} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS day, count(*) AS n, round(avg(duration_ms), 6) AS avg_duration_ms FROM r GROUP BY 1",
)
def win24(spark, sf):
    return results(spark, sf).groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"))


@query("MTH1_token_cost", f"WITH {RESULTS} SELECT test_id, round(cost, 9) AS cost FROM rc WHERE status = 'success'")
def mth1(spark, sf):
    return results(spark, sf).where("status = 'success'").select("test_id", F.round(B.cost(), 9).alias("cost"))


@query(
    "MTH9_run_rates",
    f"""WITH {RESULTS}, runs AS (SELECT provider, category, count(*) FILTER (status = 'success') / count(*)::DOUBLE AS rate FROM r GROUP BY provider, category)
    SELECT provider, round(avg(rate), 6) AS avg_success_rate, count(*) AS runs FROM runs GROUP BY provider""",
)
def mth9(spark, sf):
    runs = results(spark, sf).groupBy("provider", "category").agg((F.count_if(F.col("status") == "success") / F.count("*")).alias("rate"))
    return runs.groupBy("provider").agg(F.round(F.avg("rate"), 6).alias("avg_success_rate"), F.count("*").alias("runs"))


@query(
    "SET1_merge_results",
    f"WITH {RESULTS} SELECT test_id, status FROM (SELECT * FROM r WHERE provider = 'A' UNION ALL SELECT * FROM r WHERE category = '2-HIGH')",
)
def set1(spark, sf):
    all_results = results(spark, sf)
    return all_results.where("provider = 'A'").unionByName(all_results.where("category = '2-HIGH'")).select("test_id", "status")


@query(
    "SET2_hash_dedupe",
    "SELECT doc_id, sha256(text) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1",
)
def set2(spark, sf):
    """Keep-first by content hash: an aggregate, so copies meet after counting down, not in a sorted group."""
    from verdigris.plans.fixtures import table

    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


@query(
    "AGG19_run_lists",
    f"""WITH {RESULTS} SELECT provider, model, count(*) AS runs, round(avg(rate), 6) AS mean_rate, round(coalesce(stddev_pop(rate), 0.0), 6) AS sd_rate
      FROM (SELECT provider, model, date_trunc('month', ts) AS month, count(*) FILTER (status = 'success') / count(*)::DOUBLE AS rate FROM r GROUP BY ALL) GROUP BY provider, model""",
)
def agg19(spark, sf):
    """Moments of per-run rates: what a list of runs would be collected for."""
    runs = results(spark, sf).groupBy("provider", "model", F.date_trunc("month", "ts").alias("month")).agg((F.count_if(F.col("status") == "success") / F.count("*")).alias("rate"))
    return runs.groupBy("provider", "model").agg(F.count("*").alias("runs"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.stddev_pop("rate"), 6).alias("sd_rate"))
