"""Embedding whitening from exact sums: digit-slice products, merged as big integers.

Vectors become whole numbers. Their second moments are sums of products that doubles cannot hold exactly, so each number is cut
into limbs of ``LIMB`` bits; the products of two limbs' matrices are taken by BLAS in doubles, where every partial sum stays below
2^53 and is exact. The limbs' products are put together as big integers, and tasks' sums are merged as such through a
reduction tree. Only n, the sums and the products of the dimensions reach the driver. The covariance is

    (n * products - sums * sums) / n^2

in whole numbers, rounded once to doubles when all is summed: nothing is lost to a large mean. Its eigenvectors are the
components. They come from Jacobi rotations (up to ``MOST_JACOBI`` dimensions, beyond from LAPACK), which keep small eigenvalues
exact beside much larger ones; how many have variance is the rank of the whole numbers, not a matter of rounding.

The fit list is each distinct vector once: partial aggregation takes hot vectors out before the shuffle. It is checkpointed, as it is
read twice, the second time to measure the covariance of the whitened vectors.

Defined results: vectors that are null, hold null or non-finite entries, or have another length than most (of equally
common lengths the longest counts) are dropped; repeated rows have rows of their own, and count once in the fit; null ids stay;
a component without variance has a null ``whitened`` and takes no part in ``identity_error``, which is null if there is none;
``explained`` is null if nothing varies; ``deviation`` is null where it is beyond a long (``deviation_digits`` has it in any case);
entries that are beyond 2^50 are an error; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import checkpoint

#: A limb's bits, and the rows of one product: ROWS * 2^(2 * LIMB) is 2^52.
LIMB, ROWS = 18, 1 << 16
COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Levels of the reduction tree.
DEPTH = 4
MOST_JACOBI, SWEEPS = 512, 40
#: The prime that the rank is found by.
PRIME = (1 << 31) - 1


def finite(column: str) -> Column:
    """False (or null) for vectors that are null, or hold null or non-finite entries."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.forall(F.col(column).cast("array<double>"), entry)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows with finite vectors of the commonest length."""
    kept = vectors.where(finite(column))
    sizes = kept.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return kept.where(F.size(column) == (sizes["size"] if sizes else 0))


def whole(column: str, scale: int, offset: int) -> Column:
    """floor(scale * entry) + offset of each entry, as longs."""
    one = lambda c: F.when(F.abs(c) < float(1 << 50), F.floor(c * scale) + offset).otherwise(F.raise_error(F.lit("an entry is beyond 2^50")).cast("long"))
    return F.transform(F.col(column).cast("array<double>"), one)


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles l with x = sum of l[i] * 2^(LIMB * i); all but the last are from 0 to 2^LIMB - 1, the last is of either sign."""
    out = []
    while np.abs(x).max(initial=0) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray) -> np.ndarray:
    """x.T @ x of longs, exactly, as big integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[i:], i):
                p = (a.T @ b).astype(np.int64).astype(object)
                total += (p if i == j else p + p.T) << (LIMB * (i + j))
    return total


def moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and products of the rows, in whole numbers of any size."""
    sums = sum((part.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i) for at in range(0, len(x), ROWS) for i, part in enumerate(limbs(x[at : at + ROWS]))), np.zeros(x.shape[1], object))
    return len(x), sums, products(x)


def merged(a, b):
    """Two tasks' states, entry by entry; either may be None."""
    if a is None or b is None:
        return b if a is None else a
    return tuple(u + v for u, v in zip(a, b))


def total(rows: DataFrame, state, merge):
    """The states of all tasks, merged through a tree; None without rows. ``state`` is made of each batch's matrix."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                found = merge(found, state(matrix(batch.column(0))))
        yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(found)]})

    return rows.mapInArrow(each, "state binary").rdd.map(lambda r: pickle.loads(r[0])).treeAggregate(None, merge, merge, DEPTH)


def centred(n: int, sums: np.ndarray, product: np.ndarray) -> np.ndarray:
    """The covariance times n^2, in whole numbers."""
    return n * product - np.multiply.outer(sums, sums)


def rank(whole: np.ndarray) -> int:
    """Of a matrix of whole numbers: elimination modulo a prime."""
    a, found = (whole % PRIME).astype(np.int64), 0
    for column in range(a.shape[1]):
        rows = np.flatnonzero(a[found:, column])
        if not len(rows):
            continue
        a[[found, found + rows[0]]] = a[[found + rows[0], found]]
        a[found] = a[found] * pow(int(a[found, column]), -1, PRIME) % PRIME
        a[found + 1 :] = (a[found + 1 :] - a[found + 1 :, column : column + 1] * a[found] % PRIME) % PRIME
        found += 1
    return found


def rotations(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors (columns) of a symmetric matrix without negative ones, by cyclic Jacobi rotations until each
    entry is small against its own two diagonal entries."""
    a, q, n = v.copy(), np.eye(len(v)), len(v)
    for _ in range(SWEEPS):
        still = True
        for i in range(n - 1):
            for j in range(i + 1, n):
                off, x, y = a[i, j], a[i, i], a[j, j]
                if off == 0 or abs(off) <= 1e-16 * abs(x * y) ** 0.5:
                    continue
                still = False
                half = (y - x) / (2 * off)
                t = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(1.0, half))
                c = 1 / np.hypot(1.0, t)
                turn = np.array([[c, c * t], [-c * t, c]])
                pair = [i, j]
                a[:, pair] = a[:, pair] @ turn
                a[pair] = turn.T @ a[pair]
                a[i, j] = a[j, i] = 0.0
                a[i, i], a[j, j] = x - t * off, y + t * off
                q[:, pair] = q[:, pair] @ turn
        if still:
            break
    return a.diagonal().copy(), q


def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues in falling order, and their unit vectors as columns, the largest entry of each positive."""
    values, vectors = rotations(v) if len(v) <= MOST_JACOBI else np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if len(v) else np.ones(0)
    return np.maximum(values, 0.0), vectors * signs


def spread(a, b):
    """(n, mean, centred products) of two sets of rows together; either may be None."""
    if a is None or b is None:
        return b if a is None else a
    (n, m, c), (k, o, d) = a, b
    gap = o - m
    return n + k, m + gap * (k / (n + k)), c + d + np.multiply.outer(gap, gap) * (n * k / (n + k))


class Whitening:
    """What a fit has: n, sums, eigenvalues, components and the trace."""

    def __init__(self, n: int, sums: np.ndarray, product: np.ndarray, most: int):
        exact = centred(n, sums, product)
        v = np.array([[entry / (n * n) for entry in line] for line in exact.tolist()], np.float64).reshape(exact.shape)  # rounds once
        self.n, self.sums, self.trace = n, sums, float(np.trace(v))
        self.values, self.components = eigen(v, most)
        self.varies = (np.arange(len(self.values)) < rank(exact)) & (self.values > 0)
        self.small = max(map(abs, sums.tolist()), default=0) < 1 << 60

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: as longs where these hold them, else as big integers."""
        if self.small and np.abs(x).max(initial=0) < (1 << 60) // self.n:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def squares(self, deviation: np.ndarray) -> list[int]:
        """The sum of squares of each row, exactly."""
        most = int(max(abs(deviation.max(initial=0)), abs(deviation.min(initial=0))))
        if most * most * deviation.shape[1] >= 1 << 63:
            deviation = deviation.astype(object)
        return (deviation * deviation).sum(axis=1).tolist()

    def project(self, deviation: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in components without variance."""
        scale = np.where(self.varies, np.sqrt(np.where(self.varies, self.values, 1.0)), np.nan)
        return ((deviation / self.n).astype(np.float64) @ self.components) / scale


def fit(points: DataFrame, most: int = COMPONENTS) -> tuple[Whitening, float | None] | None:
    """Of distinct vectors of longs (the only column): the fit, and the largest absolute entry of the whitened vectors'
    covariance minus the identity. None without vectors."""
    distinct = checkpoint(points.distinct())
    found = total(distinct, moments, merged)
    if found is None:
        return None
    model = Whitening(*found, most)
    if not model.varies.any():
        return model, None
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def whitened(x: np.ndarray):
        model = shared.value
        z = model.project(model.deviations(x))[:, model.varies]
        mean = z.mean(axis=0)
        return len(z), mean, (z - mean).T @ (z - mean)

    n, _, squares = total(distinct, whitened, spread)
    return model, float(np.abs(squares / n - np.eye(len(squares))).max())


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(key, component, n, deviation, deviation_digits, whitened, explained, identity_error): a row for each usable
    vector and component."""
    rows = usable(vectors.select(key, column), column).select(key, whole(column, scale, offset).alias("_x"))
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string("component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double").fields])
    found = fit(rows.select("_x"), most)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared, error = rows.sparkSession.sparkContext.broadcast(found[0]), found[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        share = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            rows = batch.num_rows
            if not rows * k:
                continue
            deviation = model.deviations(matrix(batch.column("_x")))
            squares = model.squares(deviation)
            again = np.repeat(np.arange(rows), k)
            column = lambda values, kind: pa.array(values, kind, from_pandas=True)  # noqa: E731  NaN is null
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(again)),
                    column(np.tile(np.arange(1, k + 1, dtype=np.int32), rows), pa.int32()),
                    column(np.full(rows * k, model.n, np.int64), pa.int64()),
                    pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()).take(pa.array(again)),
                    pa.array(list(map(str, squares)), pa.string()).take(pa.array(again)),
                    column(model.project(deviation).ravel(), pa.float64()),
                    column(np.tile(share, rows), pa.float64()),
                    column(np.full(rows * k, np.nan if error is None else error), pa.float64()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(each, schema)
