"""The comparison matrix of many models is dealt over tasks."""

import duckdb
from pyspark.sql import functions as F

from verdigris.operators import ranking
from verdigris.plans.fixtures import model_results


def test_a_large_comparison_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MODELS_AT_ONCE", 20, raising=False)
    models = model_results(spark, "/root/testdata/sf0.001").withColumn("provider", F.lit("one"))
    n = ranking.scored(models).count()
    found = ranking.comparison_matrix(models, "provider")
    rows = found.withColumn("task", F.spark_partition_id()).cache()
    assert rows.count() == n * n == rows.select("model_a", "model_b").distinct().count()
    assert rows.select("task").distinct().count() > 1
    quality = {r["model"]: r["quality"] for r in ranking.scored(models).collect()}
    assert all(abs(r["difference"] - (quality[r["model_a"]] - quality[r["model_b"]])) < 2e-6 for r in rows.limit(2000).collect())


def shuffled_rows(spark):
    """By stage, of all jobs so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_a_comparison_shuffles_its_models_and_not_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MODELS_AT_ONCE", 1)
    models = model_results(spark, "/root/testdata/sf0.001").withColumn("provider", F.substring("provider", 1, 5))  # the same for all
    n, groups = ranking.scored(models).count(), 8 * 4  # for each of four tasks
    assert n > 5 * groups
    before = set(shuffled_rows(spark))
    assert ranking.comparison_matrix(models, "provider").count() == n * n
    rows = sum(v for k, v in shuffled_rows(spark).items() if k not in before)
    assert 0 < rows <= n * (groups + 4)


def test_differences_are_rounded_as_in_sql(spark):
    numbers = [0.0, -1e-17, 1e-17, 0.1234565, -0.1234565, 0.0000005, -0.0000005, 0.00000049999999999999, 2.5, -2.5, 1 / 3, -2 / 3, 1e12 + 0.3, -1e300, float("inf"), float("nan"), None]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(ranking.to_six_places(F.col("x"))).collect()]
    sql = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in numbers]
    assert all(a == b or a != a and b != b for a, b in zip(found, sql))
    assert str(found[0]) == str(found[1]) == str(found[2]) == "0.0"
