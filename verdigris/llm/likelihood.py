"""Quality rules and a likelihood ratio: every document is measured, held to two base rules, and then to how much
likelier its n-grams are in trusted text than in the whole corpus.

Words and pairs of neighbouring words are hashed into ``buckets``. Two multinomials over the buckets are
counted by Spark: one from all documents (raw), one from the trusted ones (target), drawn towards the raw one with
``prior`` made-up n-grams where it has seen little. A document's score is the mean, over its n-grams, of
log(target / raw), so that long texts are not worth more than short ones. There is no draw: a document is kept
where its score reaches ``threshold``. Weights are whole numbers (units of 2^-20), so sums are exact and the
verdict is the same in any order and on any number of machines.

Both multinomials count rows, copies included, and no task holds more than their buckets; a text that makes up a third of
the corpus moves both alike where rows are trusted irrespective of it.

Defined results: a null text is an empty one; an empty text has no words and fails the base rules; long texts are read
whole; repeated rows count and are judged each; rows without an id are judged and never trusted; without
trusted rows every weight is 0, so the base rules alone decide; extra columns pass through ``keep`` untouched, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import TokenCache, held_out

#: The base rules: fewest words, and the largest share of words in repeated windows of three, in hundredths.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Units that a weight of one nat has.
UNITS = 1 << 20
#: Fixed values of the hash: words are taken modulo the first; a pair is (first word's hash * the second) + the other's + 1.
WORD_MODULUS, PAIR_FACTOR = (1 << 31) - 1, 1_000_003
#: So many words are counted at once.
CHUNK = 1 << 19
#: So many trusted ids are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST_IDS = 2_000_000

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, total long"


@dataclass(frozen=True)
class Settings:
    #: A prime, so that the hash spreads over all of them.
    buckets: int = 20_011
    prior: int = 80_044
    #: Nats per n-gram.
    threshold: float = -0.08


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word).digest()[8:], "little") % WORD_MODULUS


def grams(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    return np.concatenate([hashes, hashes[:-1] * PAIR_FACTOR + hashes[1:] + 1]) % buckets


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, at, times = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[at] > 1)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[again + k] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words, and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    characters = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    return words, (len(words), characters, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words))


def counts(docs: DataFrame, trusted: Column, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all ``docs``, and in those ``trusted``. A task sends on one line a bucket, and
    the driver gets no more than that."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenCache(word_hash)
        total = np.zeros((2, buckets), np.int64)
        waiting: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def add() -> None:
            for k, found in enumerate(waiting):
                if found:
                    total[k] += np.bincount(np.concatenate(found), minlength=buckets)
                    found.clear()

        n = 0
        for batch in batches:
            for text, good in zip(batch.column("text"), batch.column("good").to_pylist()):
                if words := (text.as_py() or "").encode("utf-8", "surrogatepass").split():
                    waiting[good].append(grams(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)), buckets))
                    n += len(words)
                if n > CHUNK:
                    add()
                    n = 0
        add()
        on = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bucket": on.astype(np.int32), "other": total[0][on], "good": total[1][on]})

    found = docs.select("text", F.coalesce(trusted, F.lit(False)).alias("good")).mapInArrow(count, "bucket int, other long, good long")
    summed = found.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("good").alias("good")).toPandas()  # at most ``buckets`` rows
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    raw[summed["bucket"]], target[summed["bucket"]] = summed["other"] + summed["good"], summed["good"]
    return raw, target


def weights(raw: np.ndarray, target: np.ndarray, prior: int) -> np.ndarray:
    """log(target / raw) of each bucket, in whole units."""
    if not target.sum():
        return np.zeros(len(raw), np.int64)
    share = (raw + 1.0) / (raw.sum() + len(raw))
    drawn = (target + prior * share) / (target.sum() + prior)
    return np.array([math.floor(math.log(d / s) * UNITS + 0.5) for d, s in zip(drawn.tolist(), share.tolist())], np.int64)


def train(docs: DataFrame, trusted: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """The buckets' weights, from all of ``docs`` and from those whose doc_id is in ``trusted``."""
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("_good", F.lit(True))
    if ids.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return weights(*counts(docs.select("doc_id", "text").join(ids, "doc_id", "left"), F.col("_good"), settings.buckets), settings.prior)


def measures_udf(weight: np.ndarray, spark):
    """text -> ``MEASURES``; the buckets' weights are broadcast."""
    shared = spark.sparkContext.broadcast(weight)

    @F.pandas_udf(MEASURES)
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weight, hashes = shared.value, TokenCache(word_hash)
        for texts in batches:
            out = np.zeros((len(texts), 7), np.int64)
            for i, text in enumerate(texts):
                words, out[i, :5] = measure(text)
                if words:
                    found = grams(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)), len(weight))
                    out[i, 5:] = len(found), weight[found].sum()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return measures


def judged(docs: DataFrame, weight: np.ndarray, settings: Settings = Settings(), carry: str = "doc_id") -> DataFrame:
    """``carry`` and the measures, with base_failed, score (nats per n-gram; null without words) and kept."""
    least = math.floor(settings.threshold * UNITS)
    found = docs.select(carry, measures_udf(weight, docs.sparkSession)("text").alias("_m")).select(carry, "_m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    score = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams") / UNITS)
    return found.withColumns({"base_failed": failed, "score": score, "kept": ~failed & (F.col("total") >= least * F.col("n_grams"))})


def trusted_rows(labels: DataFrame) -> DataFrame:
    """Ids outside the held-out fold which every label of theirs calls good."""
    known = labels.where(~held_out("doc_id") & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")


def keep(docs: DataFrame, trusted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that are kept, with their own columns."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return judged(rows, train(docs, trusted, settings), settings, "_row").where("kept").select("_row.*")


def report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document."""
    found = judged(docs, train(docs, trusted_rows(labels), settings), settings)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
