"""Keyed writes to a table of files, in storage that all executors share.

Each run writes the whole table anew beside the last version and is put in place by one rename, so a reader never
sees half a run, and a task that is tried again or a run that failed leaves no row behind. A version's name tells which run made it: a run that comes again changes
nothing. One run writes at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, at: str) -> list[tuple[int, int]]:
    """(version, run) of each version there is, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    return sorted((int(version), int(run)) for version, _, run in (n.removeprefix("version-").partition("-run-") for n in names if n.startswith("version-")))


def place(at: str, version: int, run: int) -> str:
    return f"{at}/version-{version}-run-{run}"


def read(spark: SparkSession, at: str) -> DataFrame:
    """The last version."""
    return spark.read.parquet(place(at, *versions(spark, at)[-1]))


def upsert(rows: DataFrame, keys: list[str], run: int, at: str) -> bool:
    """Inserts ``rows``, or updates those whose keys are there already: a null keeps the value there is, and of rows with equal keys each column's
    largest value counts. Rows with a null key are left out. False if the run was merged before."""
    spark, there = rows.sparkSession, versions(rows.sparkSession, at)
    if any(merged == run for _, merged in there):
        return False
    values = [c for c in rows.columns if c not in keys]
    rows = rows.dropna(subset=keys)
    once = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values]) if values else rows.select(*keys).distinct()
    if there:
        old = read(spark, at)
        new = once.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
        once = old.join(new, keys, "full").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])
    written = f"{at}/_{uuid.uuid4().hex}"
    once.write.parquet(written)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.rename(path(written), path(place(at, there[-1][0] + 1 if there else 1, run))):
        raise OSError(f"run {run} could not be put in place below {at}")
    return True
