"""Vector code compression: product quantisation whose codebooks are made by a tree of sums.

A vector is cut into equal parts, and each part is coded as the nearest entry of its position's codebook. The codebooks
start as the parts of the rows with the smallest ids; each round assigns every part to its nearest entry and moves the
entries to their parts' means, in whole numbers.

Rows travel as columnar blocks: one NumPy array of ``BLOCK`` rows, dimension by dimension. A block's distances to all
entries of a codebook accumulate one dimension at a time, sums and counts by ``np.add.at`` into int64 tensors of fixed size
(parts, entries, width), and ``treeAggregate`` merges these, so neither the driver nor a task gets more than a few of them.
Every number is whole, so the order of merging changes nothing, and a lost task is computed anew from the table.

Defined results: vectors that are null, hold null or non-finite entries, or have another length than most (of equally
common lengths the longest counts) are dropped; fewer distinct ids than entries give as many entries; rows that repeat an id are
coded each, the least vector of an id starts an entry; null ids are coded and start none, so without any id the entries are of zeros;
ties go to the lower entry; an entry that no part is nearest to stays; null labels are one group; a hot label's sum is made before
the shuffle; lengths that can't be cut into equal parts and components beyond 2^50 (or whose distances could pass a long) are errors;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import checkpoint
from verdigris.llm.whitening import matrix, usable, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a columnar block.
BLOCK = 2048
#: Levels of the reduction tree.
DEPTH = 4
#: So many labels are broadcast with their sums at most; more are joined by a shuffle.
MOST_LABELS = 100_000


def columnar(x: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of rows, dimension by dimension."""
    for at in range(0, len(x), BLOCK):
        yield np.ascontiguousarray(x[at : at + BLOCK].T)


def blocks(points: DataFrame, dimensions: int) -> RDD:
    """Columnar blocks of vectors of longs (the only column)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for block in columnar(matrix(batch.column(0))):
                    narrow = block.astype(np.int32) if np.abs(block).max() < 1 << 31 else block
                    yield pa.RecordBatch.from_pydict({"wide": [narrow.itemsize == 8], "block": [narrow.tobytes()]})

    read = lambda r: np.frombuffer(r["block"], np.int64 if r["wide"] else np.int32).reshape(dimensions, -1)
    return points.mapInArrow(each, "wide boolean, block binary").rdd.map(read)


def nearest(block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), each parts x rows; of equally near entries the lowest."""
    parts, entries, width = codebooks.shape
    rows = np.arange(block.shape[1])
    codes, errors = np.empty((parts, len(rows)), np.int64), np.empty((parts, len(rows)), np.int64)
    gap, distance = np.empty((len(rows), entries), np.int64), np.empty((len(rows), entries), np.int64)
    for p in range(parts):
        distance[:] = 0
        for d in range(width):
            np.subtract.outer(block[p * width + d].astype(np.int64, copy=False), codebooks[p, :, d], out=gap)
            np.multiply(gap, gap, out=gap)
            distance += gap
        codes[p] = distance.argmin(axis=1)
        errors[p] = distance[rows, codes[p]]
    return codes, errors


def add(state: tuple[np.ndarray, np.ndarray], block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's parts added to the sums and counts of the entries nearest to them."""
    sums, counts = state
    parts, _, width = codebooks.shape
    codes, _ = nearest(block, codebooks)
    for p in range(parts):
        np.add.at(counts[p], codes[p], 1)
        for d in range(width):
            np.add.at(sums[p, :, d], codes[p], block[p * width + d])
    return sums, counts


def first_entries(rows: DataFrame, key: str, parts: int, entries: int) -> np.ndarray:
    """The codebooks (parts, entries, width) of the smallest ids, ascending."""
    ids = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(entries)
    found = rows.join(F.broadcast(ids), key).groupBy(key).agg(F.min("_x").alias("_x")).orderBy(key).collect()  # at most ``entries`` rows
    if not found:
        size = rows.select(F.size("_x")).first()[0]
        return np.zeros((parts, 1, size // parts), np.int64)
    x = np.array([r["_x"] for r in found], np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def codebooks_of(rows: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts, entries, width) after ``rounds`` rounds over all rows."""
    books = first_entries(rows, key, parts, entries)
    columns = blocks(rows.select("_x"), books.shape[0] * books.shape[2])
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        zero = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        sums, counts = columns.treeAggregate(zero, lambda state, block: add(state, block, shared.value), lambda a, b: (a[0] + b[0], a[1] + b[1]), DEPTH)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with code and error in place of the vector."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_x"] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    names, shared = schema.names[:-2], rows.sparkSession.sparkContext.broadcast(books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(block, shared.value) for block in columnar(matrix(batch.column("_x")))]
            digits = np.concatenate([codes for codes, _ in found], axis=1).T.astype(np.uint8)
            errors = np.concatenate([e.sum(axis=0) for _, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array([line.tobytes().hex() for line in digits]), pa.array(errors)], names=schema.names)

    return rows.mapInArrow(each, schema)


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each usable vector."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    rows = usable(vectors.select(key, F.col(label).alias("_label"), column), column).select(key, "_label", whole(column, scale, 0).alias("_x"))
    bound = rows.agg(F.max(F.array_max(F.transform("_x", F.abs))).alias("most"), F.max(F.size("_x")).alias("size")).first()
    if bound["size"] is None:
        return spark.createDataFrame([], T.StructType([rows.schema[key], *T._parse_datatype_string("code string, error long, label_error long, codebooks_sha256 string").fields]))
    if not bound["size"] or bound["size"] % parts:
        raise ValueError(f"vectors of {bound['size']} components can't be cut into {parts} equal parts")
    if bound["size"] * (2 * (bound["most"] or 0) + 1) ** 2 >= 1 << 63:
        raise ValueError(f"components up to {bound['most']} have distances beyond a long")
    books = codebooks_of(rows, key, parts, entries, rounds)
    found = checkpoint(coded(rows, books))
    sums = found.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        sums = F.broadcast(sums)
    joined = found.join(sums, F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
