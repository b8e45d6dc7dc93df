"""Toxicity: non-negative positive-unlabelled learning.

Only confirmed toxic examples count as labels. Everything else is unlabelled: a sample of the documents
that somebody has looked at (rows of ``labels`` outside the held-out fold, toxic ones among them, their
labels not read). The share of toxic rows there is the class prior pi. With it and a loss l, the risk of a
classifier g is estimated as

    pi * mean_P l(g, 1)  +  max(0,  mean_U l(g, 0) - pi * mean_P l(g, 0))

whose second term, the risk on negatives, is kept from falling below zero (Kiryo et al. 2017).
When it does fall below, the step goes the other way and undoes the overfitting.

Defined results: a null or empty text scores what the intercept says (no features); repeated rows
are scored each; very long texts are read whole; extra columns pass through untouched; an empty
table gives an empty result; without any confirmed toxic example every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm import features
from verdigris.llm.common import TokenCache, held_out, sample_ids

THRESHOLD = 0.5


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the model."""

    positives: int = 2000
    unlabelled: int = 6000
    columns: int = 256
    #: A word counts as often as it occurs, up to this.
    most_count: int = 4
    least_documents: int = 3
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    chosen: np.ndarray
    weights: np.ndarray
    intercept: float
    most_count: int


def divergence(df_u: np.ndarray, df_p: np.ndarray, n_u: float, n_p: float) -> np.ndarray:
    """How much more often than in unlabelled text a word occurs in confirmed toxic text, in nats
    over all positives: p log(p/u), with half a document added against rare words."""
    p = (df_p + 0.5) / (n_p + 1)
    u = (df_u + df_p + 1.0) / (n_u + n_p + 2)
    return np.abs(p * np.log(p / u))


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic classifier with the least non-negative risk (Adam)."""
    scale = np.maximum(x.std(axis=0), 1e-3) ** 0.5
    x = (x / scale).astype(np.float32)
    p, u = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    soft = lambda z: np.logaddexp(0, z)
    sig = lambda z: 0.5 * (1 + np.tanh(z / 2))
    for step in range(1, s.steps + 1):
        zp, zu = p @ w + b, u @ w + b
        negative_risk = soft(zu).mean() - prior * soft(zp).mean()
        g_pos = -prior * (1 - sig(zp)) / len(zp)
        g_neg_p, g_neg_u = -prior * sig(zp) / len(zp), sig(zu) / len(zu)
        if negative_risk >= 0:
            gp, gu = g_pos + g_neg_p, g_neg_u
        else:
            gp, gu = -g_neg_p, -g_neg_u
        gp, gu = gp.astype(np.float32), gu.astype(np.float32)
        grad = np.concatenate([gp @ p + gu @ u + s.decay * w, [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), float(b - move[-1])
    return (w / scale).astype(np.float64), float(b)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most ``positives`` confirmed toxic and ``unlabelled`` other documents, all from rows of
    ``labels`` outside the held-out fold. The prior is the share of toxic rows among all its labels. Of rows
    with one id, the least text is used."""
    s = settings
    known = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    toxic = sample_ids(known.where("toxic = 1"), "doc_id", s.positives, s.seed).withColumn("cls", F.lit(1))
    other = sample_ids(labels.where(~held_out("doc_id")), "doc_id", s.unlabelled, s.seed + 1).withColumn("cls", F.lit(0))
    ids = toxic.unionByName(other)  # a toxic document may be in the unlabelled sample too, as the estimator asks
    sample = features.one_text(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), ["doc_id", "cls"])
    chosen, rows, x = features.training_matrix(sample, features.words, s.columns, s.least_documents, divergence)
    positive = rows["cls"].to_numpy() == 1
    if not prior or not positive.any() or positive.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), -50.0, s.most_count)
    w, b = fit_nnpu(np.minimum(x, s.most_count), positive, min(max(prior, 1e-4), 0.9), s)
    return Model(chosen, w, b, s.most_count)


def score_udf(model: Model):
    """text -> probability of being toxic."""
    lookup = features.column_lookup(model.chosen)
    weights, intercept, most = model.weights, model.intercept, model.most_count

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = TokenCache(lambda t: weights[c] if (c := lookup[features.hashed(t)]) >= 0 else 0.0)
        for texts in batches:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                z = intercept
                for token, n in Counter(features.words(text or "")).items():
                    if w := weight[token]:
                        z += w * min(n, most)
                out[i] = 0.5 * (1 + np.tanh(z / 2))
            yield pd.Series(out)

    return score


def score(docs: DataFrame, model: Model, text: str | Column = "text", into: str = "score") -> DataFrame:
    return docs.withColumn(into, score_udf(model)(text))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents scored below ``THRESHOLD``, with their own columns."""
    scored = docs.select(F.struct("*").alias("row"), score_udf(train(docs, labels, settings))("text").alias("p"))
    return scored.where(F.col("p") < THRESHOLD).select("row.*")
