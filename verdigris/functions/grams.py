"""Character n-grams and word n-grams of a few texts at a time, as whole numbers: what tasks compare texts by.

An n-gram's number is made of its characters' numbers, so equal numbers are equal n-grams; nothing is hashed. The numbers hold
within one call. Sizes and shared counts of all pairs of the texts come from one product of a table of zeros and ones, a bounded
part of it at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: So many cells of a table of n-grams by texts are multiplied at a time.
CELLS = 1 << 22
#: Bits of a code point.
POINT = 21


def folded(symbols: np.ndarray, n: int, width: int) -> np.ndarray:
    """Runs of n symbols of ``width`` bits, each run a number. Runs that would not fit are numbered in order first."""
    m = len(symbols) - n + 1
    code, used = symbols[:m], width
    for i in range(1, n):
        if used + width > 63:
            code = np.unique(code, return_inverse=True)[1]
            used = int(code.max()).bit_length()
        code, used = code << width | symbols[i : i + m], used + width
    return code


def runs(symbols: np.ndarray, lengths: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, text) of each n-gram of texts that lie one after another."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if len(symbols) < n:
        return np.zeros(0, np.int64), owner[:0]
    whole = owner[: len(symbols) - n + 1] == owner[n - 1 :]
    return folded(symbols, n, width)[whole], owner[: len(whole)][whole]


def char_grams(texts: Sequence[str | None], sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, (number, text) of each n-gram; a null text has none."""
    texts = [t or "" for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    lengths, width = np.array([len(t) for t in texts]), POINT
    if max(sizes) * POINT > 63 and len(points):
        points = np.unique(points, return_inverse=True)[1]
        width = max(1, int(points.max()).bit_length())
    return [runs(points, lengths, n, width) for n in sizes]


def word_grams(texts: Sequence[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, text) of each run of n words, cut at each space; a null text has none."""
    words = [[] if t is None else t.split(" ") for t in texts]
    known: dict[str, int] = {}
    symbols = np.array([known.setdefault(w, len(known)) for each in words for w in each], np.int64)
    return runs(symbols, np.array([len(w) for w in words]), n, max(1, len(known).bit_length()))


def shared(number: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """How many distinct elements each two of the texts share; a text's own number of them lies on the diagonal."""
    ids = np.unique(number, return_inverse=True)[1]
    total, step = np.zeros((texts, texts)), max(1, CELLS // texts)
    n = int(ids.max()) + 1 if len(ids) else 0
    order = np.argsort(ids, kind="stable") if n > step else None
    for first in range(0, n, step):
        if order is None:
            row, column = ids, owner
        else:
            some = order[np.searchsorted(ids, first, sorter=order) : np.searchsorted(ids, first + step, sorter=order)]
            row, column = ids[some] - first, owner[some]
        table = np.zeros((min(step, n - first), texts), np.float32)
        table[row, column] = 1
        total += table.T @ table
    return total


def jaccard(common: np.ndarray, empty: float) -> np.ndarray:
    """Of each two texts, from ``shared``; ``empty`` where neither has an element."""
    size = np.diag(common)
    union = size[:, None] + size[None, :] - common
    return np.where(union > 0, common / np.maximum(union, 1), empty)
