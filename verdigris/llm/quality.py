"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text's vector is its tf-idf weighted words and word shapes, projected on the leading singular
vectors of a labelled sample (latent semantic analysis) and scaled to length one. The labelled
vectors are broadcast; for every document the cosines to all of them are exact, computed as matrix
products of blocks. The labels of the ``neighbours`` nearest vote with a weight that rises with the
cosine; all that tie with the last of them vote too.

Defined results: a text without any known feature (null, empty) scores the share of good labels;
repeated rows are scored each; long texts are read whole; extra columns pass through untouched; an
empty table gives an empty result; without labels every score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import features
from verdigris.llm.common import TokenCache, held_out, sample_ids

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """Bounds of the labelled sample (what is broadcast) and of the space."""

    labelled: int = 3000
    columns: int = 4096
    least_documents: int = 3
    rank: int = 48
    neighbours: int = 15
    sharpness: float = 4.0
    block: int = 256
    seed: int = 11


@dataclass(frozen=True)
class Model:
    chosen: np.ndarray
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    settings: Settings

    @property
    def prior(self) -> float:
        return float(self.votes.mean()) if len(self.votes) else 1.0


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_lsa(counts: np.ndarray, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """idf, projection and the rows' unit vectors: a randomised truncated SVD with power steps."""
    n = len(counts)
    idf = (np.log((1.0 + n) / (1.0 + (counts > 0).sum(axis=0))) + 1.0).astype(np.float32)
    x = unit(np.log1p(counts) * idf).astype(np.float32)
    rank = max(1, min(rank, n, x.shape[1]))
    q = x @ np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 8, x.shape[1]))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x @ (x.T @ q))
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    projection = np.ascontiguousarray(vt[:rank].T)
    return idf, projection, unit(x @ projection)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most ``labelled`` labelled documents outside the held-out fold; of rows with one id, on the least text."""
    s = settings
    known = labels.where(~held_out("doc_id") & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    ids = sample_ids(known, "doc_id", s.labelled, s.seed)
    votes = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("quality").cast("int").alias("cls"))
    sample = features.one_text(docs.select("doc_id", "text").join(F.broadcast(votes), "doc_id"), ["doc_id", "cls"])
    chosen, rows, x = features.training_matrix(
        sample, features.words_and_shapes, s.columns, s.least_documents, lambda df0, df1, n0, n1: df0 + df1
    )
    if not len(rows):
        return Model(chosen, np.zeros(1), np.zeros((1, 1)), np.zeros((0, 1)), np.zeros(0), s)
    idf, projection, vectors = fit_lsa(x, s.rank, s.seed)
    return Model(chosen, idf, projection, vectors, rows["cls"].to_numpy(np.float32), s)


def vote(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Scores of unit row vectors: exact cosines to every labelled vector, in one product."""
    s = model.settings
    known = np.abs(vectors).sum(axis=1) > 0
    if not len(model.votes):
        return np.ones(len(vectors))
    cosine = vectors @ model.vectors.T
    k = min(s.neighbours, cosine.shape[1])
    least = np.partition(cosine, -k, axis=1)[:, -k][:, None]
    weight = np.where(cosine >= least, np.maximum(cosine, 1e-6) ** s.sharpness, 0)
    return np.where(known, (weight @ model.votes) / weight.sum(axis=1), model.prior)


def score_udf(model: Model, spark):
    """text -> weighted share of good labels among the nearest; the model is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        lookup = features.column_lookup(model.chosen)
        block = model.settings.block
        column = lambda token: int(lookup[features.hashed(token)])
        cache = TokenCache(lambda token: (column(token), column("\x00" + features.shape(token))))
        again = column("\x00again")
        weighted = model.projection * model.idf[:, None]

        def vector(text: str) -> np.ndarray:
            tokens = text.split()
            pairs = [cache[t] for t in tokens]
            cols = [c for pair in pairs for c in pair]
            if again >= 0:
                cols += [again] * sum(a == b for a, b in zip(tokens, tokens[1:]))
            found, counts = np.unique(np.asarray(cols, np.int64), return_counts=True)
            on = found >= 0
            return np.log1p(counts[on].astype(np.float32)) @ weighted[found[on]]

        for texts in batches:
            out = np.empty(len(texts))
            for at in range(0, len(texts), block):
                part = [vector(t or "") for t in texts[at : at + block]]
                out[at : at + block] = vote(unit(np.stack(part)).astype(np.float32), model)
            yield pd.Series(out)

    return score


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents scored ``THRESHOLD`` or more, with their own columns."""
    judge = score_udf(train(docs, labels, settings), docs.sparkSession)
    return docs.select(F.struct("*").alias("row"), judge("text").alias("p")).where(F.col("p") >= THRESHOLD).select("row.*")
