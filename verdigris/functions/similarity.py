"""Similarities of two texts as column expressions. Each states what it says of empty texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions import grams
from verdigris.functions.edits import edit_distance, element_distance


def _ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(top.cast("double") / bottom)


def set_jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two arrays of distinct values; ``empty`` if both are."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(empty))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are alike."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - edit_distance(a, b) / longer)


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct runs of n characters. ``text`` should be a column, as a lambda evaluates anew for each
    run whatever expression it is given."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.char_length(text) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def word_ngrams(words: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def ngram_jaccard(a: Column, b: Column, n: int = 3, empty: float = 1.0) -> Column:
    return set_jaccard(char_ngrams(a, n), char_ngrams(b, n), empty)


def strict_ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """0 if either has no n-gram."""
    x, y = char_ngrams(a, n), char_ngrams(b, n)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(set_jaccard(x, y, 0.0))


#: Sizes of n-grams and their weights.
NGRAM_WEIGHTS = {2: 0.2, 3: 0.3, 4: 0.3, 5: 0.2}


def weighted_ngrams(texts: Sequence[str | None]) -> np.ndarray:
    """Of each two of some lower-case texts, the weighted Jaccard of their 2- to 5-grams. Sizes that either lacks are left out; equal
    texts are alike, and without any size in common two are not."""
    top, bottom = np.zeros((len(texts), len(texts))), np.zeros((len(texts), len(texts)))
    for w, (number, owner) in zip(NGRAM_WEIGHTS.values(), grams.char_grams(texts, list(NGRAM_WEIGHTS))):
        common = grams.shared(number, owner, len(texts))
        has = np.diag(common) > 0
        some = has[:, None] & has[None, :]
        top, bottom = top + np.where(some, w * grams.jaccard(common, 0.0), 0.0), bottom + np.where(some, w, 0.0)
    known: dict = {}
    alike = np.array([-1 - i if t is None else known.setdefault(t, len(known)) for i, t in enumerate(texts)])
    return np.where(alike[:, None] == alike[None, :], 1.0, top / np.where(bottom > 0, bottom, 1.0))


def strict_ngrams(texts: Sequence[str | None], n: int = 3) -> np.ndarray:
    """``strict_ngram_jaccard`` of each two of some texts."""
    ((number, owner),) = grams.char_grams(texts, [n])
    return grams.jaccard(grams.shared(number, owner, len(texts)), 0.0)


@F.pandas_udf(T.DoubleType())
def _weighted(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ngrams(pair)[0, 1] for pair in zip(a, b)], dtype="float64")


def with_weighted_ngrams(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """Adds the weighted Jaccard of 2- to 5-grams of two text columns; sizes that neither text has are
    left out."""
    return df.withColumn(into, _weighted(F.lower(a), F.lower(b)))


def keywords(text: Column) -> Column:
    """Distinct lower-case words of more than two letters, cut at anything but letters, digits and _."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.char_length(w) > 2))


def keyword_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(keywords(a), keywords(b), 1.0)


def keyword_coverage(claim: Column, reference: Column) -> Column:
    """Share of the claim's keywords that the reference has; 0 without keywords."""
    mine = keywords(claim)
    return _ratio(F.size(F.array_intersect(mine, keywords(reference))), F.size(mine), 0.0)


def stripped_tokens(text: Column) -> Column:
    """Punctuation taken out, then words of more than two letters, distinct."""
    plain = F.regexp_replace(F.lower(text), r"[^\w\s]", "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.char_length(w) > 2))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of stripped tokens; 0 if either has none."""
    x, y = stripped_tokens(a), stripped_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(set_jaccard(x, y, 0.0))


def space_jaccard(a: Column, b: Column) -> Column:
    """Of lower-case words cut at white space; the empty word counts."""
    return set_jaccard(F.array_distinct(F.split(F.lower(a), r"\s+")), F.array_distinct(F.split(F.lower(b), r"\s+")), 0.0)


def structural(a: Column, b: Column) -> Column:
    """Half the ratio of lengths, half the ratio of paragraph counts."""
    ratio = lambda x, y: F.when(F.greatest(x, y) == 0, F.lit(1.0)).otherwise(F.least(x, y) / F.greatest(x, y))
    paragraphs = lambda t: F.size(F.filter(F.split(t, r"\n\n+"), lambda p: F.trim(p) != ""))
    return 0.5 * ratio(F.char_length(a), F.char_length(b)) + 0.5 * ratio(paragraphs(a), paragraphs(b))


def expected_overlap(content: Column, expected: Column) -> Column:
    """Expected words, repeats counted, found in the content, over the size of the union; at most 1."""
    c, e = F.split(F.lower(content), r"\s+"), F.split(F.lower(expected), r"\s+")
    hits = F.size(F.filter(e, lambda w: F.array_contains(c, w)))
    return F.least(F.lit(1.0), _ratio(hits, F.size(F.array_union(c, e)), 0.0))


def with_word_error_rate(df: DataFrame, reference: str, hypothesis: str, into: str) -> DataFrame:
    """Adds word edits over reference words."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    df = df.withColumns({"_r": words(F.col(reference)), "_h": words(F.col(hypothesis))})
    rate = F.when(F.size("_r") == 0, F.when(F.size("_h") == 0, 0.0).otherwise(1.0)).otherwise(element_distance(F.col("_r"), F.col("_h")) / F.size("_r"))
    return df.withColumn(into, rate).drop("_r", "_h")


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    n = F.char_length(reference)
    return F.when(n == 0, F.when(F.char_length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(edit_distance(reference, hypothesis) / n)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(_dot(a, b) / norm)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
