"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Cutting a uniformly random order of all rows into shards is the same as three steps that no task needs
all rows for. How many rows each part of the input sends to each shard follows a multivariate
hypergeometric law; the driver draws that matrix exactly, from the parts' sizes alone. Each part
permutes its own rows and deals out as many as its line of the matrix says. Each shard permutes what
it has got.

Random order within a part or shard is the order of a hash of the row's number and the seed. Large
shards are put in order piece by piece: pieces are ranges of that hash, and a piece starts where the
pieces before it end.

The row numbers are fixed by a checkpoint of the narrow table (id, size, checksum), so a lost executor
changes nothing that follows.

Defined results: a null text has size 1 and checksum 0; repeated rows and null ids each have a place
of their own; equal counts of rows differ by at most one between shards, the first shards having one
more; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import checkpoint

SHARDS = 8
SEED = 20_231
ROWS_IN_PIECE = 500_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good. Exact for any size (numpy's own stops at 1e9): inverts the
    distribution, summed outwards from its mode as far as it weighs anything in double precision."""
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mean = drawn * good / total
    spread = math.sqrt(max(mean * (bad / total) * (total - drawn) / max(1, total - 1), 0.0))
    reach = int(12 * spread) + 40
    mode = min(max(int((drawn + 1) * (good + 1) / (total + 2)), low), high)
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    rise = np.cumsum(np.log((good - up) * (drawn - up)) - np.log((up + 1) * (bad - drawn + up + 1)))
    fall = np.cumsum(np.log(down * (bad - drawn + down)) - np.log((good - down + 1) * (drawn - down + 1)))
    weight = np.exp(np.concatenate([fall[::-1], [0.0], rise]))
    share = np.cumsum(weight)
    return mode - len(down) + int(np.searchsorted(share, rng.random() * share[-1], side="right"))


def split(rng: np.random.Generator, parts: list[int], drawn: int) -> list[int]:
    """How many of ``drawn`` rows, taken without replacement, come from each part."""
    if len(parts) == 1:
        return [drawn]
    half = len(parts) // 2
    left, right = parts[:half], parts[half:]
    from_left = hypergeometric(rng, sum(left), sum(right), drawn)
    return split(rng, left, from_left) + split(rng, right, drawn - from_left)


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """matrix[p][s]: rows that part p sends to shard s. Lines sum to the parts', columns to the shards' sizes."""
    rng, left, columns = np.random.default_rng(seed), list(parts), []
    for size in shards[:-1]:
        column = split(rng, left, size) if left else []
        left = [a - b for a, b in zip(left, column)]
        columns.append(column)
    return [list(line) for line in zip(*columns, left)]


def equal_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffle(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, whatever other columns they have. They should be narrow: they are checkpointed and sorted twice."""
    if taken := {"shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"rows have columns of these names already: {sorted(taken)}")
    spark = rows.sparkSession
    fixed = checkpoint(rows.select(F.struct("*").alias("_in"), F.monotonically_increasing_id().alias("_row")))
    n = fixed.count()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_IN_PIECE))
    fixed = fixed.withColumns({"_part": F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(parts)).cast("int"), "_a": F.xxhash64(F.lit(seed + 1), "_row")})
    counted = {r["_part"]: r["count"] for r in fixed.groupBy("_part").count().collect()}  # one row per part
    sizes = [counted.get(p, 0) for p in range(parts)]
    upto = np.cumsum(communication_matrix(sizes, equal_sizes(n, shards), seed), axis=1).tolist() if n else [[0] * shards]
    line = F.broadcast(spark.createDataFrame([(p, u) for p, u in enumerate(upto)], "_part int, _upto array<long>"))
    # permute locally, then exchange: the k-th row of a part goes to the first shard whose share reaches k
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_a", "_row"))
    dealt = (
        fixed.withColumn("_k", place)
        .join(line, "_part")
        .withColumn("shard", F.size(F.filter("_upto", lambda u: u < F.col("_k"))))
        .drop("_upto", "_k", "_a", "_part")
    )
    # permute again, piece by piece
    pieces = max(1, -(-n // (shards * ROWS_IN_PIECE)), parts // shards)
    second = F.xxhash64(F.lit(seed + 2), "_row")
    piece = F.shiftrightunsigned(F.shiftrightunsigned(second, 32) * F.lit(pieces), 32).cast("int")
    dealt = dealt.withColumns({"_b": F.shiftrightunsigned(second, 1), "_piece": piece})
    dealt = checkpoint(dealt)
    sums, starts = {}, []
    for r in sorted(dealt.groupBy("shard", "_piece").count().collect()):  # one row per piece
        starts.append((r["shard"], r["_piece"], sums.get(r["shard"], 0)))
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["count"]
    first = F.broadcast(spark.createDataFrame(starts, "shard int, _piece int, _start long"))
    within = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_b", "_row"))
    return dealt.withColumn("slot", within).join(first, ["shard", "_piece"]).withColumn("slot", F.col("_start") + F.col("slot") - 1).select("_in.*", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``rows``."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return shuffle(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
