"""Metric values out of result files, whatever level of them holds the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a metric stands in a result; other metrics stand under their own name.
PATHS = {"overall": "$.duration_ms", "duration": "$.duration_ms", "latency": "$.duration_ms", "tokens": "$.tokens_used", "cost": "$.estimated_cost"} | {m: f"$.metrics.{m}" for m in ("faithfulness", "relevance", "coherence")}


def path_of(metric: str) -> str:
    return PATHS.get(metric, f"$.{metric}")


def number_at(json: Column, path: str) -> Column:
    """The number there; null where there is none, or something else than a number."""
    found = F.try_variant_get(F.try_parse_json(json), path, "variant")
    is_number = F.schema_of_variant(found).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(is_number, F.try_variant_get(found, "$", "double"))


def metric_values(files: DataFrame, metric: str) -> DataFrame:
    """(id, values) for each file (id, json): the metric of all its ``results``; if none has it, that of its ``summary``;
    if that hasn't, of the ``results`` of all the objects that the file is a list of. No value anywhere: an empty list,
    which a caller may take as an error, as a command over one file does."""
    path = path_of(metric)
    some = lambda results: F.filter(F.transform(F.coalesce(results, F.array().cast("array<string>")), lambda r: number_at(r, path)), lambda v: v.isNotNull())
    is_list = F.col("json").rlike(r"^\s*\[")
    one = F.when(~is_list, F.from_json("json", "results array<string>, summary string"))
    many = F.when(is_list, F.from_json("json", "array<struct<results: array<string>>>"))
    read = files.select("id", one.alias("one"), many.alias("many")).select(
        "id", some(F.col("one.results")).alias("own"), some(F.array("one.summary")).alias("summary"), some(F.flatten(F.filter("many.results", lambda r: r.isNotNull()))).alias("listed")
    )
    return read.select("id", F.when(F.size("own") > 0, F.col("own")).when(F.size("summary") > 0, F.col("summary")).otherwise(F.col("listed")).alias("values"))
