"""Hashed bag-of-token features of whole texts, and a bounded training matrix of them.

Tokens are hashed to ``DIMS`` features on the executors. Which of them a model uses is decided from
document frequencies that Spark counts over the whole sample, so what reaches the driver is at most
``rows * columns`` numbers, however long a text is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 18
WORD = re.compile(r"[^\W_]+")


def hashed(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & (DIMS - 1)


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall(text.lower())


def shape(token: str) -> str:
    """The token with each run of letters or digits reduced to one sign: ``The,`` is ``Aa,``."""
    out = []
    for ch in token:
        kind = "0" if ch.isdigit() else "A" if ch.isupper() else "a" if ch.isalpha() else ch
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def words_and_shapes(text: str) -> list[str]:
    """Words as written, their shapes, and a mark for each word that repeats the one before."""
    tokens = text.split()
    marks = ["\x00again" for a, b in zip(tokens, tokens[1:]) if a == b]
    return tokens + ["\x00" + shape(t) for t in tokens] + marks


def features_udf(tokens: Callable[[str], list[str]]):
    """text -> map-like pair of arrays: distinct hashed features in order, and their counts."""

    @F.pandas_udf("ids array<int>, counts array<int>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ids, counts = [], []
            for text in texts:
                found = Counter(map(hashed, tokens(text or "")))
                keys = sorted(found)
                ids.append(keys)
                counts.append([found[k] for k in keys])
            yield pd.DataFrame({"ids": ids, "counts": counts})

    return features


def one_text(sample: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of the ``keys``, with the least of its texts: rows that repeat an id don't add to
    what is trained on, however many there are."""
    return sample.groupBy(*keys).agg(F.min("text").alias("text"))


def training_matrix(
    sample: DataFrame, tokens: Callable[[str], list[str]], columns: int, least: int, rank
) -> tuple[np.ndarray, pd.DataFrame, np.ndarray]:
    """(hashed features chosen, the rows' other columns, dense counts of rows by features).

    ``sample`` has ``text`` and ``cls`` (0 or 1) and, after ``one_text``, is of bounded size. ``rank(df0, df1, n0, n1)``
    scores features by their document frequencies in the classes; the best ``columns`` with at
    least ``least`` documents are used. Ties go to the smaller hash.
    """
    found = (
        sample.withColumn("f", features_udf(tokens)("text"))
        .select(*[c for c in sample.columns if c != "text"], "f.ids", "f.counts")
        .persist()
    )
    freq = (
        found.select("cls", F.explode("ids").alias("id"))
        .groupBy("id")
        .agg(F.sum(F.lit(1) - F.col("cls")).alias("df0"), F.sum("cls").alias("df1"))
        .where(F.col("df0") + F.col("df1") >= least)
        .toPandas()  # at most DIMS rows
        .sort_values("id")
    )
    sizes = {r["cls"]: float(r["count"]) for r in found.groupBy("cls").count().collect()}
    df0, df1 = freq["df0"].to_numpy(float), freq["df1"].to_numpy(float)
    order = np.argsort(-rank(df0, df1, sizes.get(0, 0.0), sizes.get(1, 0.0)), kind="stable")[:columns]
    chosen = np.sort(freq["id"].to_numpy(np.int64)[order])
    lookup = column_lookup(chosen)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for i, c in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist()):
                cols = lookup[np.asarray(i, dtype=np.int64)]
                ids.append(cols[cols >= 0])
                counts.append(np.asarray(c, dtype=np.int32)[cols >= 0])
            new = {"ids": pa.array(ids, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays(
                [new.get(name, old) for name, old in zip(batch.schema.names, batch.columns)], schema=batch.schema
            )

    rows = found.mapInArrow(narrow, found.schema).toPandas()
    found.unpersist()
    rows = rows.sort_values([c for c in rows.columns if c not in ("ids", "counts")]).reset_index(drop=True)
    dense = np.zeros((len(rows), max(1, len(chosen))), np.float32)
    for r, (i, c) in enumerate(zip(rows["ids"], rows["counts"])):
        dense[r, np.asarray(i, dtype=np.int64)] = c
    return chosen, rows.drop(columns=["ids", "counts"]), dense


def column_lookup(chosen: np.ndarray) -> np.ndarray:
    """hashed feature -> column of the model, or -1."""
    lookup = np.full(DIMS, -1, np.int32)
    lookup[chosen] = np.arange(len(chosen), dtype=np.int32)
    return lookup
