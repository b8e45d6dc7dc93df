"""The relations that queries run on, built from the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test results: a line item is a test, its order's priority the category, its return flag the
    provider, its line number the model, its supplier the repository."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    part = F.pmod(F.col("l_orderkey"), F.lit(20))
    status = F.when(part == 0, "failure").when(part == 1, "timeout").when(part == 2, "skipped").otherwise("success")
    answered = lambda c: F.when(F.col("status") == "success", F.floor(c).cast("long"))
    return (
        items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
        .withColumn("status", status)
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("test_id"),
            F.col("l_orderkey").alias("run_key"),
            F.col("l_partkey").alias("part_key"),
            F.col("l_returnflag").alias("provider"),
            F.concat(F.lit("model-"), F.col("l_linenumber").cast("string")).alias("model"),
            F.col("o_orderpriority").alias("category"),
            F.col("l_suppkey").alias("repository"),
            "status",
            F.floor("l_extendedprice").cast("long").alias("duration_ms"),
            answered(F.col("l_quantity") * 20).alias("prompt_tokens"),
            answered(F.col("l_quantity") * 10).alias("completion_tokens"),
            F.col("l_discount").alias("score"),
            F.col("l_quantity").cast("int").alias("level"),
            F.col("l_shipdate").alias("ts"),
        )
    )


RESULTS = """
r AS (
  SELECT *, CASE WHEN status = 'success' THEN CAST(floor(l_quantity * 20) AS BIGINT) END AS prompt_tokens,
            CASE WHEN status = 'success' THEN CAST(floor(l_quantity * 10) AS BIGINT) END AS completion_tokens
  FROM (
    SELECT l_orderkey || '-' || l_linenumber AS test_id, l_orderkey AS run_key, l_partkey AS part_key, l_returnflag AS provider, 'model-' || l_linenumber AS model,
           o_orderpriority AS category, l_suppkey AS repository,
           CASE l_orderkey % 20 WHEN 0 THEN 'failure' WHEN 1 THEN 'timeout' WHEN 2 THEN 'skipped' ELSE 'success' END AS status,
           CAST(floor(l_extendedprice) AS BIGINT) AS duration_ms, l_quantity, l_discount AS score, CAST(l_quantity AS INT) AS level, l_shipdate AS ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
), rc AS (SELECT *, prompt_tokens / 1000.0 * 0.03 + completion_tokens / 1000.0 * 0.06 AS cost, prompt_tokens + completion_tokens AS tokens FROM r)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated outputs of a prompt: a conversation is a group, its turns the outputs (at most eight
    by the table's own rule)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("ordinal"), F.col("text").alias("content"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims to verify: the turns of conversations."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("claim_id"), F.col("text").alias("claim"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What claims are held against: the benchmark's items (a table of bounded size)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("reference_id"), F.col("text").alias("reference"))


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model of an orchestrated comparison: a part is a model, of the brand that offers it."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("ordinal"),
        F.col("p_brand").alias("provider"),
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("model"),
        (F.col("p_partkey") % 17 != 0).alias("success"),
        (F.col("p_size") / 50.0).alias("faithfulness"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 100 / 100.0).alias("relevance"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") % 10 / 10.0).alias("coherence"),
        F.floor(F.col("p_retailprice")).cast("long").alias("latency_ms"),
        F.when(F.col("p_partkey") % 11 == 0, 0.0).otherwise(F.col("p_retailprice") / 100000.0).alias("cost"),
    )


MODELS = """
m AS (
  SELECT p_partkey AS ordinal, p_brand AS provider, 'part-' || p_partkey AS model, p_partkey % 17 <> 0 AS success, p_size / 50.0 AS faithfulness,
         CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 100) / 100.0 END AS relevance, CASE WHEN p_partkey % 4 <> 0 THEN (p_size % 10) / 10.0 END AS coherence,
         CAST(floor(p_retailprice) AS BIGINT) AS latency_ms, CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE p_retailprice / 100000.0 END AS cost
  FROM part)
"""
