"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints that differ in at most three bits link; components of links are the groups. Since three
differences cannot touch all four 16-bit blocks, two linked fingerprints agree in one block. So each
distinct fingerprint is rotated four ways, and every rotation is dealt out by its leading block.
There, rotated fingerprints are sorted by Gray rank, which puts codes that differ in few bits side by
side. Runs of eight become nodes, runs of eight nodes become nodes above them, up to a root for each
leading block. A node keeps the bits that all below it share. Two nodes whose shared bits already
differ in more than three places are pruned with all that is below them; so are two nodes that are
known to be in one component, so a group of copies costs no quadratic work. Out come the edges of a
spanning star, never all pairs of a group.

Blocks that hold very many fingerprints are dealt out again by the same argument: their other 48 bits
are cut into four parts of 12, one of which two linked fingerprints share as well. A task holds one such
block of distinct fingerprints at a time, which agree in 28 bits.

Joins by a component's root or a fingerprint meet as many rows of one key as its group is large; adaptive
execution splits such partitions, as nothing is collected within a key.

Defined results: null and empty texts have the fingerprint zero, which links like any other;
repeated rows share a fingerprint and a component; a null doc_id takes part but never names a
component unless nothing else can, and then the component is null; long texts are read whole; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import checkpoint

SEED = 42
MOST_DIFFERENT = 3
SHINGLE = 3
FANOUT = 8
#: Leading blocks with more fingerprints than this are dealt out again.
LARGE_BLOCK = 4096
#: So many fingerprints are indexed at a time (more only if one block has more), and so many pairs
#: of nodes are compared at a time.
INDEXED_AT_ONCE, PAIRS_AT_ONCE = 1 << 17, 1 << 14


def fingerprint_of(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    n = max(1, len(found) - SHINGLE + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist() if len(found) >= SHINGLE else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """text -> fingerprint as a signed 64-bit integer."""
    for texts in batches:
        yield pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))


def gray_rank(code: Column) -> Column:
    """Where the code stands in Gray order; its leading bits depend on the code's leading bits only."""
    for shift in (32, 16, 8, 4, 2, 1):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def rotated(code: Column, bits: int) -> Column:
    return code if bits == 0 else F.shiftleft(code, bits).bitwiseOR(F.shiftrightunsigned(code, 64 - bits))


def dealt(codes: DataFrame) -> DataFrame:
    """(block, fp, code): each fingerprint under its four leading blocks, or, where one of these is
    large, under that block and each of four further parts. ``code`` is rotated so that what is
    shared leads."""
    four = codes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(r).alias("turn"), rotated(F.col("fp"), 16 * r).alias("code")) for r in range(4)])).alias("r"),
    ).select("fp", "r.turn", "r.code", F.shiftrightunsigned("r.code", 48).alias("lead"))
    large = four.groupBy("turn", "lead").count().where(F.col("count") > LARGE_BLOCK).select("turn", "lead", F.lit(1).alias("large"))
    # at most 4 * 65,536 blocks exist, however many fingerprints there are
    both = four.join(F.broadcast(large), ["turn", "lead"], "left")
    rest = F.shiftleft("code", 16)  # the other 48 bits, leading
    part = lambda k: F.struct(
        (F.lit(k + 1)).alias("part"),
        F.shiftrightunsigned(F.shiftleft(rest, 12 * k), 52).alias("sub"),
    )
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("sub")))
    return both.select(
        "fp", "turn", "lead", "code", F.explode(F.when(F.col("large").isNull(), whole).otherwise(F.array(*map(part, range(4))))).alias("p")
    ).select(
        F.shiftleft("lead", 16).bitwiseOR(F.shiftleft(F.col("turn").cast("long"), 32)).bitwiseOR(F.shiftleft(F.col("p.part").cast("long"), 40)).bitwiseOR(F.col("p.sub")).alias("block"),
        gray_rank(F.col("code")).alias("rank"),
        "fp",
    )


class Node:
    """One level of the index: what all fingerprints below each node share, and where these are."""

    def __init__(self, ones: np.ndarray, some: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.ones, self.some, self.first, self.last = ones, some, first, last
        self.shared = ~(ones ^ some)


def build(codes: np.ndarray, block_starts: np.ndarray) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """Levels from the fingerprints up; a level's children are at first..last of the one below. The
    last two results are the range of each block's nodes on the top level, which has one for each."""
    n = len(codes)
    index = np.arange(n)
    levels = [Node(codes, codes, index, index + 1)]
    starts, stops = block_starts, np.append(block_starts[1:], n)
    while True:
        sizes = stops - starts
        groups = -(-sizes // FANOUT)
        new_stops = np.cumsum(groups)
        new_starts = new_stops - groups
        which = np.repeat(np.arange(len(starts)), groups)
        first = starts[which] + FANOUT * (np.arange(new_stops[-1]) - new_starts[which])
        last = np.minimum(first + FANOUT, stops[which])
        below = levels[-1]
        levels.append(Node(np.bitwise_and.reduceat(below.ones, first), np.bitwise_or.reduceat(below.some, first), first, last))
        starts, stops = new_starts, new_stops
        if (groups <= 1).all():
            return levels, starts, stops


def settle(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := root[root], root):
        root = up
    return root


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[i] with b[i]; each root is the smallest position of its set."""
    while True:
        ra, rb = root[a], root[b]
        if not (apart := ra != rb).any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        root = settle(root)


def links_within(codes: np.ndarray, block_starts: np.ndarray) -> np.ndarray:
    """For fingerprints in Gray order within each block: the position of each one's root in its block."""
    levels, tops, _ = build(codes, block_starts)
    n = len(codes)
    root = np.arange(n)
    inner = np.ones(n, bool)
    inner[block_starts] = False
    near = np.flatnonzero(inner & (np.bitwise_count(codes ^ np.roll(codes, 1)) <= MOST_DIFFERENT))
    root = unite(root, near, near - 1)  # neighbours in Gray order first: most groups close at once

    def span(level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = nodes, nodes + 1
        for at in range(level, 0, -1):
            low, high = levels[at].first[low], levels[at].last[high - 1]
        return low, high

    offsets = np.arange(FANOUT)
    stack = [(len(levels) - 1, tops, tops)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        node, below = levels[level], levels[level - 1]
        i = (node.first[a][:, None] + offsets)[:, :, None]
        j = (node.first[b][:, None] + offsets)[:, None, :]
        ok = (i < node.last[a][:, None, None]) & (j < node.last[b][:, None, None]) & (i <= j if level > 1 else i < j)
        pair, x, y = np.nonzero(ok)
        i, j = i[pair, x, 0], j[pair, 0, y]
        different = np.bitwise_count((below.ones[i] ^ below.ones[j]) & below.shared[i] & below.shared[j])
        on = different <= MOST_DIFFERENT
        i, j = i[on], j[on]
        if level == 1:
            root = unite(root, i, j)
        elif len(i):
            # a pair of nodes whose fingerprints are all in one component has nothing left to find
            (lo_i, hi_i), (lo_j, hi_j) = span(level - 1, i), span(level - 1, j)
            changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            one = (changes[hi_i - 1] == changes[lo_i]) & (changes[hi_j - 1] == changes[lo_j]) & (root[lo_i] == root[lo_j])
            if not one.all():
                stack.append((level - 1, i[~one], j[~one]))
    return root


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, rank, fp) sorted by block and rank -> edges (a, b) of a star for each component."""

    def edges(block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        root = links_within(fp.view(np.uint64), starts)
        off = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[off]), pa.array(fp[root[off]])], names=["a", "b"])

    kept: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        kept.append((batch.column("block").to_numpy(), batch.column("fp").to_numpy()))
        size += len(batch)
        if size >= INDEXED_AT_ONCE and kept[0][0][0] != kept[-1][0][-1]:  # one block alone is kept until it ends
            block, fp = (np.concatenate(x) for x in zip(*kept))
            cut = int(np.searchsorted(block, block[-1]))  # the last block may go on
            yield edges(block[:cut], fp[:cut])
            kept, size = [(block[cut:], fp[cut:])], len(block) - cut
    if size:
        yield edges(*(np.concatenate(x) for x in zip(*kept)))


def links(codes: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` that connect exactly what links within
    ``MOST_DIFFERENT`` bits connect."""
    spread = dealt(codes)
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(parts, "block").sortWithinPartitions("block", spread_order("rank")).mapInArrow(linked, "a long, b long")


def spread_order(name: str) -> Column:
    """Unsigned order of a signed column."""
    return F.col(name).bitwiseXOR(F.lit(-(2**63)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node it can reach.

    Rounds of large-star and small-star (Kiveris et al. 2014), written as aggregates and joins, so no
    task holds a node's whole neighbourhood. Every round is checkpointed; rounds grow with the
    logarithm of the longest path.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = mark(edges)
    while now[0]:
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"))
            .union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
            .where("x != y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
        )
        edges = checkpoint(small)
        before, now = now, mark(edges)
        if before == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(prints: DataFrame, order: Column) -> DataFrame:
    """(fp, first): for each fingerprint the least ``order`` in its component."""
    classes = prints.groupBy("fp").agg(F.min(order).alias("first"))
    classes = checkpoint(classes)
    roots = components(links(classes.select("fp")))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("fp", "root").join(firsts, "root").select("fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text)."""
    prints = checkpoint(docs.select("doc_id", fingerprint("text").alias("fp")))
    groups = grouped(prints, F.col("doc_id"))
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group one document stays: the one with the smallest doc_id (null last), then the
    smallest hash of its text; of its repeated rows, one."""
    row = F.struct("*")
    # rows without an id come last; they are told apart by their text. Ids are of any type that sorts
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    prints = checkpoint(docs.select(key.alias("key"), fingerprint("text").alias("fp")))
    stay = grouped(prints, F.col("key")).select(F.col("first").alias("key")).distinct()
    return docs.select(key.alias("key"), row.alias("row")).join(stay, "key").dropDuplicates(["key"]).select("row.*")
