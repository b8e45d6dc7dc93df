"""Coherence of single texts: violations, the heuristic score, the overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as X

LONG_SENTENCE = 40
#: Weights of the parts of the overall score.
PARTS = {"logical_flow": 0.35, "grammar": 0.25, "consistency": 0.25, "readability": 0.15}


def violations(texts: DataFrame) -> DataFrame:
    """(id, words, markers, short, long_sentences, single_words, repeats): a text of fewer than three
    words has that violation alone."""
    # what lambdas read is a column, so it is made once per row
    t = texts.withColumns({"_s": X.sentences(F.col("text")), "_w": X.words_by_space(F.col("text")), "words": X.word_count(F.col("text"))})
    t = t.withColumn("_low", F.transform("_w", lambda w: F.lower(w)))
    counts = F.transform("_s", lambda s: F.struct(X.word_count(s).alias("n"), s.rlike(r"[?!]$").alias("closed")))
    repeat = lambda w, following: (w == following) & (F.char_length(w) > 3) & w.rlike("[a-zA-Z]")
    pairs = F.zip_with("_low", F.slice("_low", F.lit(2), F.size("_low")), repeat)
    short = F.col("words") < 3
    none_if_short = lambda c: F.when(short, 0).otherwise(c)
    return t.withColumn("_c", counts).select(
        "id", "words", X.marker_count(F.col("text")).alias("markers"), short.cast("int").alias("short"),
        none_if_short(F.size(F.filter("_c", lambda c: c["n"] > LONG_SENTENCE))).alias("long_sentences"),
        none_if_short(F.size(F.filter("_c", lambda c: (c["n"] == 1) & ~c["closed"]))).alias("single_words"),
        none_if_short(F.size(F.filter(pairs, lambda p: F.coalesce(p, F.lit(False))))).alias("repeats"),
    )


def heuristic() -> Column:
    """From the columns of ``violations``: .85, less .08 for a short text and .03 for each other
    violation, less .1 under ten words, plus .05 for a fitting density of markers; from 0 to 1."""
    density = F.col("markers") / F.greatest("words", F.lit(1))
    score = 0.85 - 0.08 * F.col("short") - 0.03 * (F.col("long_sentences") + F.col("single_words") + F.col("repeats"))
    score = score - F.when(F.col("words") < 10, 0.1).otherwise(0.0) + F.when((density > 0.02) & (density < 0.15), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def overall(high: Column | None = None) -> Column:
    """From columns named as PARTS; .1 less for each violation of high severity."""
    base = sum((F.col(n) * w for n, w in PARTS.items()), F.lit(0.0)) - (F.lit(0.1) * high if high is not None else F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))
