"""Storage that all executors share: folders for intermediate tables, and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``. Only on one machine a
    folder is made where neither is set; on a cluster that is an error, as executors could not read it."""
    context = spark.sparkContext
    named, given = context.getConf().get("spark.checkpoint.dir"), context._jsc.sc().getCheckpointDir()
    if named or given.isDefined():
        return named or given.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="verdigris-")


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the storage that all executors share."""
    return os.path.join(shared_folder(spark), uuid.uuid4().hex)


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and written by column where every executor can read them: for what is read several times, a few
    columns each time."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are computed once, written where every executor can read them."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
