"""Edit distances of texts and word lists of any length.

Short pairs go through Spark's own function. It fills a table of one length times the other, so long pairs are done here, in Arrow
batches: what both begin and end with is cut off, and of the rest a column of the table is two bit vectors, one for where it rises
and one for where it falls, of which a step is a few operations on whole numbers of as many bits as the shorter text has
elements. That is a 64th of the table's work and the memory of a column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs whose lengths multiply to more than this are long.
LONG = 1 << 18
#: Elements that occur more often than this in a text get their bits by array.
OFTEN = 16
#: Texts lie side by side in vectors of up to so many bits; a longer one is compared by itself.
BITS = 1 << 14


def trimmed(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """The two without what they begin and end with alike, found by halves."""
    for side in (0, 1):
        low, high = 0, min(len(a), len(b))
        while low < high:  # so many elements are alike, at least and at most
            half = (low + high + 1) // 2
            same = a[low:half] == b[low:half] if side == 0 else a[len(a) - half : len(a) - low] == b[len(b) - half : len(b) - low]
            low, high = (half, high) if same else (low, half - 1)
        a, b = (a[low:], b[low:]) if side == 0 else (a[: len(a) - low], b[: len(b) - low])
    return a, b


def places(pattern: Sequence, wanted: set) -> dict:
    """Where each wanted element stands in the pattern, as bits of a whole number."""
    at: dict = {}
    for i, x in enumerate(pattern):
        if x in wanted:
            at.setdefault(x, []).append(i)
    out = {}
    for x, found in at.items():
        if len(found) > OFTEN:
            bits = np.zeros(found[-1] + 1, np.uint8)
            bits[found] = 1
            out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        else:
            out[x] = sum(1 << i for i in found)
    return out


def edits(a: Sequence, b: Sequence) -> int:
    """Fewest insertions, deletions and replacements of elements that make ``b`` of ``a``."""
    a, b = trimmed(a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at, n = places(a, set(b)), len(a)
    whole, last = (1 << n) - 1, 1 << (n - 1)
    rises, falls, distance = whole, 0, n
    for x in b:
        here = at.get(x, 0)
        down = here | falls
        across = (((here & rises) + rises) ^ rises) | here
        grows, shrinks = falls | (whole & ~(across | rises)), rises & across
        distance += bool(grows & last) - bool(shrinks & last)
        grows, shrinks = (grows << 1 | 1) & whole, shrinks << 1 & whole
        rises, falls = shrinks | (whole & ~(down | grows)), grows & down
    return distance


def edit_table(texts: Sequence[str]) -> np.ndarray:
    """``edits`` of each two of some texts. Many texts lie one after another in the bit vectors, a free bit after each, which takes what an addition
    carries out of it; so a step of one text is a step against all of these. What a text's last column rises and falls by is counted at the end."""
    out, first = np.zeros((len(texts), len(texts)), np.int64), 0
    while first < len(texts):
        end, bits = first + 1, len(texts[first]) + 1
        while end < len(texts) and bits + len(texts[end]) < BITS:
            end, bits = end + 1, bits + len(texts[end]) + 1
        if bits > BITS:  # a long text by itself
            for i in range(first):
                out[i, first] = out[first, i] = edits(texts[i], texts[first])
        else:
            _table_of(texts, first, end, out)
        first = end
    return out


def _table_of(texts: Sequence[str], first: int, end: int, out: np.ndarray) -> None:
    """Fills in the edits of texts before ``end`` against the later ones of those from ``first`` on."""
    lengths = [len(t) for t in texts[first:end]]
    begins = [sum(lengths[:k]) + k for k in range(len(lengths))]
    whole, firsts = sum(((1 << n) - 1) << at for n, at in zip(lengths, begins)), sum(1 << at for n, at in zip(lengths, begins) if n)
    joined = "\0".join(texts[first:end])
    at = {x: bits & whole for x, bits in places(joined, set(joined)).items()}
    for i in range(end - 1):
        left = max(0, i + 1 - first)  # the texts from here on are met by text i
        cut = begins[left]
        mask, ones, b = whole >> cut, firsts >> cut, texts[i]
        here_of = {x: at.get(x, 0) >> cut for x in set(b)}
        rises, falls = mask, 0
        for x in b:
            here = here_of[x]
            down = here | falls
            across = (((here & rises) + rises) ^ rises) | here
            grows = (falls | (mask & ~(across | rises))) << 1 & mask | ones
            shrinks = (rises & across) << 1 & mask
            rises, falls = shrinks | (mask & ~(down | grows)), grows & down
        for k in range(left, len(lengths)):
            field, place = (1 << lengths[k]) - 1, begins[k] - cut
            found = len(b) + (rises >> place & field).bit_count() - (falls >> place & field).bit_count()
            out[i, first + k] = out[first + k, i] = found


@F.pandas_udf(T.IntegerType())
def _long_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    listed = lambda x: x if isinstance(x, str) else list(x)
    return pd.Series([None if x is None or y is None else edits(listed(x), listed(y)) for x, y in zip(a, b)], dtype="Int32")


def edit_distance(a: Column, b: Column) -> Column:
    """Of two texts, in characters; null if either is."""
    long = F.char_length(a).cast("long") * F.char_length(b) > LONG
    short = lambda c: F.when(long, F.lit("")).otherwise(c)
    return F.when(long, _long_edits(F.when(long, a), F.when(long, b))).otherwise(F.levenshtein(short(a), short(b)))


def element_distance(a: Column, b: Column) -> Column:
    """Of two lists, in elements, whatever their lengths; null if either is."""
    return _long_edits(a, b)
