"""What the operators of this package share: folds, shared storage, token caches."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder are never used to learn labels.
FOLDS = 5


def held_out(doc_id: str | Column) -> Column:
    """True for the fold that labels are not learnt from; a null id is never held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into reliable storage that every executor can read.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests on
    one machine) a folder is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, else the one given to
    ``setCheckpointDir``. Only on one machine a folder is made where neither is set; on a cluster that is
    an error, as executors could not read it."""
    context = spark.sparkContext
    named, given = context.getConf().get("spark.checkpoint.dir"), context._jsc.sc().getCheckpointDir()
    if named or given.isDefined():
        return named or given.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="verdigris-checkpoint-")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what an operator wrote for itself in the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_ids(keys: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct non-null keys, chosen by hash: the same ones on every run."""
    return (
        keys.where(F.col(key).isNotNull())
        .select(key)
        .distinct()
        .orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
        .limit(most)
    )


class TokenCache(dict):
    """token -> value, computed once; bounded by keeping two generations of tokens.

    A full generation becomes the old one; tokens met again move back. Long tokens are not kept.
    """

    def __init__(self, compute, size: int = 120_000, longest: int = 64):
        super().__init__()
        self.compute, self.size, self.longest, self.old = compute, size, longest, {}

    def __missing__(self, token):
        value = self.old.get(token)
        if value is None:
            value = self.compute(token)
        if len(token) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[token] = value
        return value
