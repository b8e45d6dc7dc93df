"""A stated set of query vectors against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many numbers of queries are broadcast at a time, and so many products are made at a time.
NUMBERS_IN_BLOCK, PRODUCTS_AT_ONCE = 4 << 20, 1 << 20


#: So many vectors of each length are centres at most, and lengths that have any: the commonest.
CENTRES, LENGTHS = 64, 16
#: Room for rounding in bounds of angles and products.
ROOM = 1e-5


class Products:
    """How many products of a query and a vector were made, and how many were known to be too small."""

    def __init__(self, spark: SparkSession):
        self.made, self.skipped = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def share_skipped(self) -> float:
        return self.skipped.value / max(1, self.made.value + self.skipped.value)


def centres_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors of the table by length, chosen by hash."""
    usable = vectors.where("size(embedding) > 0 AND exists(embedding, x -> x <> 0) AND forall(embedding, x -> x IS NOT NULL)")
    common = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(LENGTHS)
    out = {}
    for n in [r["n"] for r in common.collect()]:
        rows = usable.where(F.size("embedding") == n).select("embedding").orderBy(F.xxhash64("vec_id", "embedding")).limit(CENTRES).collect()
        x = np.array([r["embedding"] for r in rows], float)
        out[n] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.where((n := np.sqrt((x * x).sum(axis=1, keepdims=True))) > 0, n, 1)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def similar_vectors(vectors: DataFrame, queries: DataFrame, least: float, counted: Products | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, euclidean, dot) for each pair of a query (query_id, q) and a vector
    (vec_id, embedding) with at least that cosine, rounded to six places as the others are. Null and empty vectors
    and those of another length than a query's have no pair with it; a vector of length 0 has the cosine 0.

    Queries are taken in blocks of bounded size, by hash, so what is broadcast does not grow with their number. A task
    puts the vectors of a batch with the nearest of ``CENTRES`` of their length. The angle between a query and a vector is at least
    that between the query and the centre less the widest angle of the centre's vectors in the batch, so centres whose bound
    is beyond the threshold's angle are passed over with all of them. Of the others unit vectors are multiplied with unit
    queries; only pairs near the threshold or above it are looked at one by one. ``counted`` is told how many products
    were made and how many were not.
    """
    asked = queries.where("size(q) > 0").select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"))
    numbers = asked.agg(F.sum(F.size("q"))).first()[0] or 0
    blocks = max(1, -(-numbers // NUMBERS_IN_BLOCK))
    centres = centres_of(vectors)
    found = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow()
        one = against(vectors, rows, least, centres, counted)
        found = one if found is None else found.unionByName(one)
    return found


def against(vectors: DataFrame, queries: pa.Table, least: float, centres: dict[int, np.ndarray], counted: Products | None) -> DataFrame:
    ids, lists = queries.column("query_id").combine_chunks(), queries.column("q").to_pylist()
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in {len(q) for q in lists}:
        at = np.array([i for i, q in enumerate(lists) if len(q) == length])
        by_length[length] = at, np.array([lists[i] for i in at], float).reshape(len(at), length)
    to_centres = {n: angle(unit(by_length[n][1]) @ c.T) for n, c in centres.items() if n in by_length}
    shared = vectors.sparkSession.sparkContext.broadcast((ids, by_length, centres, to_centres))
    widest = angle(np.array(least)) + ROOM
    id_types = T.StructField("query_id", T._parse_datatype_string(_type_of(ids))), T.StructField("vec_id", vectors.schema["vec_id"].dataType)
    schema = T.StructType([*id_types, *(T.StructField(c, T.DoubleType()) for c in ("cosine", "euclidean", "dot"))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by_length, centres, to_centres = shared.value
        for batch in batches:
            lengths = np.array([-1 if n is None else n for n in batch.column("n").to_pylist()])
            for length, (which, queries) in by_length.items():
                at = np.flatnonzero(lengths == length)
                if not len(at):
                    continue
                flat = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                here = flat.reshape(len(at), length)
                names = batch.column("vec_id").take(pa.array(at))
                for members, asked in near(here, queries, centres.get(length), to_centres.get(length), widest):
                    if counted:
                        counted.made.add(len(members) * len(asked))
                        counted.skipped.add(len(members) * (len(queries) - len(asked)))
                    step = max(1, PRODUCTS_AT_ONCE // max(1, len(asked)))
                    for first in range(0, len(members) if len(asked) else 0, step):
                        some = members[first : first + step]
                        yield from pairs(ids, which[asked], queries[asked], names.take(pa.array(some)), here[some], least)

    narrow = vectors.where("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.size("embedding").alias("n"))
    return narrow.mapInArrow(compare, schema)


def near(vectors: np.ndarray, queries: np.ndarray, centres: np.ndarray | None, to_centres: np.ndarray | None, widest: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of vectors, rows of queries): which have to be multiplied. Vectors and queries of length 0 have no angle, and are
    never passed over."""
    every, zero = np.arange(len(queries)), ~vectors.any(axis=1)
    if centres is None:
        yield np.arange(len(vectors)), every
        return
    products = unit(vectors) @ centres.T
    nearest = np.where(zero, -1, products.argmax(axis=1))
    no_angle = ~queries.any(axis=1)
    for c in np.unique(nearest):
        members = np.flatnonzero(nearest == c)
        if c < 0:
            yield members, every
            continue
        radius = angle(products[members, c]).max() + ROOM
        yield members, np.flatnonzero((to_centres[:, c] - radius <= widest) | no_angle)


def pairs(ids: pa.Array, which: np.ndarray, queries: np.ndarray, vec_ids: pa.Array, vectors: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    v, q = np.nonzero(unit(vectors) @ unit(queries).T >= least - ROOM)
    a, b = vectors[v], queries[q]
    dot = (a * b).sum(axis=1)
    norm = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    cosine = np.round(np.divide(dot, norm, out=np.zeros(len(dot)), where=norm > 0), 6)
    on = np.flatnonzero(cosine >= least)
    if len(on):
        distance = np.sqrt(((a - b) ** 2).sum(axis=1))
        columns = [ids.take(pa.array(which[q[on]])), vec_ids.take(pa.array(v[on])), *(pa.array(x[on]) for x in (cosine, np.round(distance, 6), np.round(dot, 6)))]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "cosine", "euclidean", "dot"])


def _type_of(ids: pa.Array) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(ids.type).simpleString()
