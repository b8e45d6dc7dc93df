"""Exact percentiles by rank, in the three definitions that results are reported with.

``rank``     value number ceil(p (n - 1)), counted from 0; no interpolation
``nearest``  value number max(0, ceil(p n) - 1): nearest rank
``middle``   the mean of the two middle values (p is ignored)

Values are counted before they are shuffled, and the distinct ones are cut into sorted ranges, a group's like a whole
table's. Counts by group and range tell which ranges hold the ranks asked for; only in these values are put in order, so no
group is collected into a list, and a hot group of distinct values is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.ranges import ranged
from verdigris.functions.running import group, sums_before


def _at(kind: str, p: float, n: Column) -> tuple[Column, Column]:
    """The first and last rank (from 1) that the percentile is the mean of."""
    if kind == "rank":
        at = F.ceil(F.lit(float(p)) * (n - 1)) + 1
        return at, at
    if kind == "nearest":
        at = F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * n))
        return at, at
    if kind == "middle":
        return F.floor((n + 1) / 2), F.floor(n / 2) + 1
    if kind == "floor":  # value number min(floor(n p), n - 1)
        at = F.least(F.floor(n * F.lit(float(p))) + 1, n)
        return at, at
    raise ValueError(f"unknown kind of percentile: {kind}")


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One row per group with a column for each of ``wanted`` (name -> (kind, p)), p from 0 to 1.

    Null values are left out; a group without values has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    fixed = ranged(counts.select(group(keys).alias("_g"), "_v", "_c"), "_g", "_v")
    ranks = {name: _at(kind, p, F.col("_total")) for name, (kind, p) in wanted.items()}
    inside = lambda rank: (rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_sum"))
    asked = sums_before(fixed, F.col("_c")).where(F.greatest(*[inside(rank) for pair in ranks.values() for rank in pair], F.lit(False)))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_g", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = fixed.join(asked.drop("_sum"), ["_g", "_range"]).withColumn("_upto", upto)
    out = []
    for name, (low, high) in ranks.items():
        first = F.min(F.when(F.col("_upto") >= low, F.col("_v")))
        last = F.min(F.when(F.col("_upto") >= high, F.col("_v")))
        out.append((first if wanted[name][0] != "middle" else (first + last) / 2).alias(name))
    return ranked.groupBy("_g").agg(*out).select(*[F.col("_g")[k].alias(k) for k in keys], *wanted)


def with_percentiles(summary: DataFrame, df: DataFrame, keys: list[str], value: str, wanted: Mapping[str, tuple[str, float]], empty=0) -> DataFrame:
    """``summary`` (one row per group) with the percentiles joined on, ``empty`` where a group has no values."""
    found = percentiles(df, keys, value, wanted)
    kind = {f.name: f.dataType for f in found.schema}
    if not keys:
        joined = summary.join(F.broadcast(found), how="left")
    else:
        other = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *wanted)
        on = [summary[k].eqNullSafe(other[f"_{k}"]) for k in keys]
        joined = summary.join(other, on, "left").drop(*[f"_{k}" for k in keys])
    return joined.withColumns({n: F.coalesce(n, F.lit(empty).cast(kind[n])) for n in wanted})
