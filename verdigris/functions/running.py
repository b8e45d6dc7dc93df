"""Running sums, without a task that sees a whole table or a whole hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.ranges import ranged


def group(keys: list[str]) -> Column:
    """The keys as one value, which equals its like where keys are null too."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("whole"))


def sums_before(fixed: DataFrame, value: Column) -> DataFrame:
    """(_g, _range, _sum, _before, _total): of each group in each range, what is in it, in the group's ranges before it, and in
    all of the group. ``fixed`` is in ranges of ``_g`` and an order; a group has a line for each range it is in."""
    lines = fixed.groupBy("_g", "_range").agg(F.sum(value).alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumns({"_before": upto - F.col("_sum"), "_total": F.sum("_sum").over(Window.partitionBy("_g"))})


def running_sum(df: DataFrame, by: str, value: Column, into: str, *then: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of ``value`` (whole numbers) over all rows of a group of ``keys`` up to each one, in the order of ``by`` and, within equal
    ones, of ``then``. ``df`` is evaluated once and sorted range by range; what lies before a range is a broadcast line for
    each range that goes on with a group, so there are no more of them than ranges."""
    fixed = ranged(df.withColumn("_g", group(list(keys))), "_g", by, *then)
    before = sums_before(fixed, value).where(F.col("_before") != 0).select("_g", "_range", "_before")
    within = F.sum(value).over(Window.partitionBy("_g", "_range").orderBy(by, *then).rowsBetween(Window.unboundedPreceding, 0))
    return fixed.withColumn(into, within).join(F.broadcast(before), ["_g", "_range"], "left").withColumn(into, F.col(into) + F.coalesce("_before", F.lit(0))).drop("_g", "_range", "_before")
