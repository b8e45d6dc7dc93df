"""A record store on snapshots: jobs, workers, evaluations. Changes make a new snapshot; nothing is
updated in place. ``as_of`` stands for the present, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")


def insert(snapshot: DataFrame, new: DataFrame) -> DataFrame:
    """Appends; records whose id is there already are an error of the caller, and left as they are."""
    return snapshot.unionByName(new.join(snapshot.select("id"), "id", "left_anti"), allowMissingColumns=True)


def update(snapshot: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Partial update by id: null in ``changes`` keeps the old value; ``updated_at`` becomes ``as_of``
    where there was a change."""
    columns = [c for c in changes.columns if c != "id"]
    j = snapshot.join(changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit")), "id", "left")
    out = [F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in snapshot.columns if c not in ("id", "updated_at")]
    touched = [F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at")).alias("updated_at")] if "updated_at" in snapshot.columns else []
    return j.select("id", *out, *touched)


def delete(snapshot: DataFrame, ids: DataFrame) -> DataFrame:
    return snapshot.join(ids.select("id"), "id", "left_anti")


def cleanup(snapshot: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Without records in a terminal status that are older than ``days``."""
    old = F.col("status").isin(*TERMINAL) & (F.col("created_at") < as_of - F.make_interval(days=F.lit(days)))
    return snapshot.where(~F.coalesce(old, F.lit(False)))


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """Pending jobs by priority, then age, then id."""
    return jobs.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(n)


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "completed", "failed")])


def load() -> Column:
    return F.when(F.sum("capacity") > 0, F.sum("tasks") / F.sum("capacity")).otherwise(0.0)


def cluster_metrics(workers: DataFrame) -> DataFrame:
    """Workers by status (active: idle or busy), capacity in all, used and free (never below 0), and the load."""
    return workers.agg(
        F.count("*").alias("workers"), F.count_if(F.col("status").isin("idle", "busy")).alias("active"), *[F.count_if(F.col("status") == s).alias(s) for s in ("idle", "busy", "failed", "offline")],
        F.sum("capacity").alias("capacity"), F.sum("tasks").alias("tasks"), F.greatest(F.lit(0), F.sum("capacity") - F.sum("tasks")).alias("free"), F.round(load(), 6).alias("load"),
    )


def cluster_health(workers: DataFrame, as_of: Column, check_s: int, unhealthy_s: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """A worker is healthy if it is idle or busy and was heard of less than ``check_s`` ago, degraded if less than
    ``unhealthy_s`` ago, else unhealthy. One unhealthy worker makes the cluster unhealthy; one degraded, or a load over
    0.9, degraded."""
    silent = F.unix_timestamp(as_of) - F.unix_timestamp("heartbeat")
    up = F.col("status").isin("idle", "busy")
    healthy, known = F.count_if(up & (silent < check_s)), F.count_if(up & (silent < unhealthy_s))
    counted = workers.groupBy(*keys).agg(healthy.alias("healthy"), (F.greatest(known, healthy) - healthy).alias("degraded"), (F.count("*") - F.greatest(known, healthy)).alias("unhealthy"), F.round(load(), 6).alias("load"))
    return counted.withColumn("status", F.when(F.col("unhealthy") > 0, "unhealthy").when((F.col("degraded") > 0) | (F.col("load") > 0.9), "degraded").otherwise("healthy"))


def with_tags(workers: DataFrame, tags: list[str]) -> DataFrame:
    return workers.where(F.forall(F.array(*map(F.lit, tags)), lambda t: F.array_contains("tags", t)))


def least_loaded(workers: DataFrame, tags: list[str]) -> DataFrame:
    """The idle worker with the tags whose load is least; no capacity counts as full."""
    load = F.when(F.col("capacity") == 0, 1.0).otherwise(F.col("tasks") / F.col("capacity"))
    return with_tags(workers.where("status = 'idle'"), tags).withColumn("load", F.round(load, 6)).orderBy("load", "id").limit(1).select("id", "load")


def retry_candidates(jobs: DataFrame, most: int) -> DataFrame:
    return jobs.where((F.col("status") == "failed") & (F.col("attempts") < most))


def recent_history(jobs: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` latest completed jobs."""
    return jobs.where("status = 'completed'").orderBy(F.desc("created_at"), F.desc("id")).limit(keep)


def latest_per(df: DataFrame, key: str, keep: int, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= keep)


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Hits, misses, entries and the rate of hits of a cache, from its lookups (key, hit)."""
    hits, n = F.count_if("hit"), F.count("*")
    return lookups.agg(hits.alias("hits"), (n - hits).alias("misses"), F.count_distinct("key").alias("size"), F.round(F.when(n > 0, hits / n).otherwise(0.0), 6).alias("hit_rate"))


def fresh(cached: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """Cached judgements that are still valid."""
    return cached.where(F.col("created_at") > as_of - F.make_interval(hours=F.lit(hours)))
