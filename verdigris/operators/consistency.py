"""Consistency of repeated outputs. Rows: group_id, ordinal, content; a group is the outputs of one prompt.

Similarities of n-grams and edit distances are made block by block: a block is some outputs of a group, and a task compares what is
in one with itself or with another block's, so the n-grams never leave the task. A large group's blocks are dealt over many tasks. Means count equal
outputs once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdigris.functions import grams

from verdigris.functions import similarity as S
from verdigris.functions import text as X
from verdigris.functions.edits import edit_distance, edit_table

#: About so many outputs of a group a task compares with the group's others.
OUTPUTS_AT_ONCE = 1_000
#: A block has about so many outputs and bytes of text; a task has so many of a group's blocks, and meets the group's others.
OUTPUTS_IN_BLOCK, BYTES_IN_BLOCK, BLOCKS_AT_ONCE = 48, 1 << 20, 16
#: The groups of more than one block are broadcast up to this many.
MOST_LARGE = 100_000


def pairs(outputs: DataFrame) -> DataFrame:
    """Each pair of a group once, i before j. A large group's outputs are dealt over several tasks, each of which has
    the group's others beside it, so no task makes all pairs of a hot group."""
    sizes = outputs.groupBy("group_id").agg(F.ceil(F.count("*") / OUTPUTS_AT_ONCE).cast("int").alias("_parts"))
    dealt = outputs.join(sizes, "group_id")
    a = dealt.select("group_id", F.pmod(F.xxhash64("ordinal", "content"), F.col("_parts")).cast("int").alias("_part"), F.col("ordinal").alias("i"), F.col("content").alias("a"))
    b = dealt.select("group_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("ordinal").alias("j"), F.col("content").alias("b"))
    return a.join(b, ["group_id", "_part"]).where("i < j").drop("_part")


def distinct_outputs(outputs: DataFrame) -> DataFrame:
    """(group_id, content, m): a group's contents in their normal form, each once, and how often it occurs; null ones are none."""
    normal = outputs.select("group_id", X.normalized(F.col("content")).alias("content")).where("content IS NOT NULL AND group_id IS NOT NULL")
    return normal.groupBy("group_id", "content").agg(F.count("*").alias("m"))


def blocks(outputs: DataFrame, rows: DataFrame, mark: str) -> DataFrame:
    """(group_id, a, b): blocks of the content and the ``mark`` of ``rows``, which are the ``outputs`` or made of them. Where b is null, a is to be
    compared with itself; over all lines each two rows of a group meet once."""
    size = F.greatest(F.count("*") / OUTPUTS_IN_BLOCK, F.sum(F.octet_length("content")) / BYTES_IN_BLOCK, F.lit(1.0))
    large = outputs.groupBy("group_id").agg(F.ceil(size).cast("int").alias("_blocks")).where("_blocks > 1 AND group_id IS NOT NULL")
    large = F.broadcast(large) if large.limit(MOST_LARGE + 1).count() <= MOST_LARGE else large
    dealt = rows.where("group_id IS NOT NULL").join(large, "group_id", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(mark, "content"), F.col("_blocks")).cast("int"))
    held = dealt.groupBy("group_id", "_blocks", "_block").agg(F.collect_list(F.struct(F.col(mark).alias("mark"), "content")).alias("a"))
    parts = F.ceil(F.col("_blocks") / BLOCKS_AT_ONCE).cast("int")
    a = held.where("_blocks > 1").select("group_id", (F.col("_block") % parts).alias("_part"), "_block", "a")
    b = held.where("_blocks > 1").select("group_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), F.col("_block").alias("_other"), F.col("a").alias("b"))
    met = a.join(b, ["group_id", "_part"]).where("_block <= _other").select("group_id", "a", F.when(F.col("_block") < F.col("_other"), F.col("b")).alias("b"))
    return held.where("_blocks = 1").select("group_id", "a", F.lit(None).cast(held.schema["a"].dataType).alias("b")).union(met)


def compared(blocks: DataFrame, measures: dict[str, Callable[[Sequence], np.ndarray]], weighted: bool = False) -> DataFrame:
    """(group_id, i, j, measures) of each two rows that meet in ``blocks``, i and j their marks; or, ``weighted``, (group_id, measures), sums over them that count a pair
    as often as the product of its marks. A measure takes some texts and gives a table of each against each."""
    marks = blocks.schema["a"].dataType.elementType["mark"].dataType
    id_type = blocks.schema["group_id"].dataType
    ends = [] if weighted else [T.StructField(c, marks) for c in ("i", "j")]
    schema = T.StructType([T.StructField("group_id", id_type), *ends, *(T.StructField(m, T.DoubleType()) for m in measures)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def lines(row: pa.RecordBatch) -> pa.RecordBatch:
        sides = [c[0].values for c in row.columns[1:] if c[0].is_valid]
        texts = [t for side in sides for t in side.field("content").to_pylist()]
        first, second = np.triu_indices(len(texts), 1)
        if len(sides) == 2:
            across = (first < len(sides[0])) & (second >= len(sides[0]))
            first, second = first[across], second[across]
        found = [m(texts)[first, second] for m in measures.values()]
        mark = pa.concat_arrays([side.field("mark") for side in sides])
        if weighted:
            times = mark.to_numpy(zero_copy_only=False).astype(float)
            times = times[first] * times[second]
            return pa.RecordBatch.from_arrays([row.column(0), *(pa.array([float(np.dot(times, f))]) for f in found)], schema=arrow)
        group = pa.array(np.zeros(len(first), np.int32))
        return pa.RecordBatch.from_arrays([row.column(0).take(group), mark.take(pa.array(first)), mark.take(pa.array(second)), *(pa.array(f, from_pandas=True) for f in found)], schema=arrow)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            for k in range(len(batch)):
                waiting.append(lines(batch.slice(k, 1)))
                n += len(waiting[-1])
                if n > 10_000:
                    yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                    waiting, n = [], 0
        if n:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    return blocks.select("group_id", "a", "b").mapInArrow(compare, schema)


def pair_measure(outputs: DataFrame, measure: Callable[[Sequence], np.ndarray], into: str) -> DataFrame:
    """(group_id, i, j, into): a measure that is the same both ways, of each pair of ``pairs``."""
    found = compared(blocks(outputs, outputs, "ordinal"), {into: measure}).where("i <> j")
    return found.select("group_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), into)


def char_likeness(texts: Sequence) -> np.ndarray:
    """Jaccard of 3-grams of each two texts; 1 where neither has any."""
    ((number, owner),) = grams.char_grams(texts, [3])
    return grams.jaccard(grams.shared(number, owner, len(texts)), 1.0)


def word_likeness(texts: Sequence) -> np.ndarray:
    """Jaccard of pairs of words of each two texts; 1 where neither has any."""
    return grams.jaccard(grams.shared(*grams.word_grams(texts, 2), len(texts)), 1.0)


def edit_likeness(texts: Sequence) -> np.ndarray:
    """1 - edits / longer length of each two texts; two empty ones are alike, and a null one has none."""
    none, n = np.array([t is None for t in texts], bool), np.array([len(t or "") for t in texts])
    longer = np.maximum(n[:, None], n[None, :])
    out = np.where(longer == 0, 1.0, 1 - edit_table([t or "" for t in texts]) / np.maximum(longer, 1))
    out[none[:, None] | none[None, :]] = np.nan
    return out


def mean_similarity(outputs: DataFrame, measures: dict[str, Callable[[Sequence], np.ndarray]]) -> DataFrame:
    """(group_id, pairs, all_equal, measures): means over a group's pairs. Equal outputs are alike, and compared once. Groups of one output have
    no pair and no row."""
    once = distinct_outputs(outputs)
    n, m = F.sum("m"), F.col("m")
    base = once.groupBy("group_id").agg((n * (n - 1) / 2).cast("long").alias("pairs"), (F.count("*") == 1).alias("all_equal"), (F.sum(m * (m - 1)) / 2).alias("_alike")).where("pairs > 0")
    sums = compared(blocks(outputs, once, "m"), measures, weighted=True).groupBy("group_id").agg(*[F.sum(c).alias(f"_{c}") for c in measures])
    means = [F.round((F.col("_alike") + F.coalesce(f"_{c}", F.lit(0.0))) / F.col("pairs"), 6).alias(c) for c in measures]
    return base.join(sums, "group_id", "left").select("group_id", "pairs", "all_equal", *means)


def set_similarity(outputs: DataFrame) -> DataFrame:
    """Group means over pairs: character 3-grams and word 2-grams; their number, and whether all are equal. Groups of one
    output have no pair and no row."""
    return mean_similarity(outputs, {"char_3gram": char_likeness, "word_2gram": word_likeness})


def pair_similarity(outputs: DataFrame) -> DataFrame:
    """``set_similarity`` and the mean likeness by edit distance, of which each pair of different contents is one."""
    return mean_similarity(outputs, {"levenshtein": edit_likeness, "char_3gram": char_likeness, "word_2gram": word_likeness})


def group_jaccard(outputs: DataFrame) -> DataFrame:
    """Tokens that all outputs of a group have, over tokens that any has; 1 without tokens."""
    sets = outputs.select("group_id", F.array_distinct(X.words_by_space(F.col("content"))).alias("tokens"))
    sizes = sets.groupBy("group_id").agg(F.count("*").alias("n"))
    per_token = sets.select("group_id", F.explode("tokens").alias("token")).groupBy("group_id", "token").agg(F.count("*").alias("in"))
    counted = per_token.join(sizes, "group_id").groupBy("group_id").agg(F.count_if(F.col("in") == F.col("n")).alias("in_all"), F.count("*").alias("in_any"))
    return sizes.join(counted, "group_id", "left").select("group_id", F.round(F.coalesce(F.col("in_all") / F.col("in_any"), F.lit(1.0)), 6).alias("jaccard"))


def tfidf_cosine(outputs: DataFrame) -> DataFrame:
    """Mean cosine of tf-idf vectors over a group's pairs, idf = ln((N + 1) / (df + 1)) + 1. No pair is made: the square
    of the sum of m unit vectors is m and twice the sum of their pairs' cosines. Outputs without words add 0."""
    words = outputs.select("group_id", "ordinal", X.words_by_space(F.col("content")).alias("w")).withColumn("length", F.size("w"))
    sizes = words.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if(F.col("length") > 0).alias("m"))
    tf = words.select("group_id", "ordinal", "length", F.explode("w").alias("word")).groupBy("group_id", "ordinal", "length", "word").agg(F.count("*").alias("c"))
    of_word = Window.partitionBy("group_id", "word")
    weighed = tf.withColumn("df", F.count("*").over(of_word)).join(sizes.select("group_id", "n"), "group_id").select(
        "group_id", "ordinal", "word", (F.col("c") / F.col("length") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("x")
    )
    norms = weighed.groupBy("group_id", "ordinal").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    total = weighed.join(norms, ["group_id", "ordinal"]).groupBy("group_id", "word").agg(F.sum(F.col("x") / F.col("norm")).alias("s"))
    square = total.groupBy("group_id").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    mean = (F.coalesce("square", F.lit(0.0)) - F.col("m")) / (F.col("n") * (F.col("n") - 1))
    return sizes.join(square, "group_id", "left").select("group_id", F.round(F.when(F.col("n") > 1, F.greatest(F.lit(0.0), mean)).otherwise(1.0), 6).alias("cosine"))


def spread(outputs: DataFrame) -> DataFrame:
    """Lengths in words and characters: mean, extremes, deviation, coefficient of variation; edit distances."""
    sized = outputs.select("group_id", F.size(X.words_by_space(F.col("content"))).alias("words"), F.char_length("content").alias("chars"))
    stats = []
    for c in ("words", "chars"):
        stats += [F.round(F.avg(c), 6).alias(f"avg_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.stddev_pop(c), 6).alias(f"sd_{c}"), F.round(F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(0.0), 6).alias(f"cv_{c}")]
    edits = pairs(outputs).withColumn("_edits", edit_distance(F.col("a"), F.col("b"))).groupBy("group_id").agg(F.round(F.avg("_edits"), 6).alias("avg_edits"), F.max("_edits").alias("max_edits"))
    return sized.groupBy("group_id").agg(*stats).join(edits, "group_id", "left")


def average_similarity(outputs: DataFrame) -> DataFrame:
    """Mean token similarity of each output to the group's others; each pair is compared once."""
    p = pairs(outputs).withColumn("s", S.space_jaccard(F.col("a"), F.col("b")))
    both = p.select("group_id", F.col("i").alias("ordinal"), "s").union(p.select("group_id", F.col("j").alias("ordinal"), "s"))
    return both.groupBy("group_id", "ordinal").agg(F.round(F.avg("s"), 6).alias("similarity"))


def outliers(outputs: DataFrame) -> DataFrame:
    """The most and the least typical output of each group; of equal ones the first."""
    a = average_similarity(outputs)
    pick = lambda sign: F.min(F.struct((F.col("similarity") * sign).alias("s"), "ordinal")).getField("ordinal")
    return a.groupBy("group_id").agg(pick(-1).alias("representative"), pick(1).alias("divergent"))


#: Lower bounds of the bands of consistency, and of quality scores.
CONSISTENCY_BANDS = (("highly_consistent", 0.95), ("consistent", 0.85), ("moderate", 0.70), ("inconsistent", 0.50))
QUALITY_BANDS = (("excellent", 0.9), ("good", 0.7), ("fair", 0.5), ("poor", 0.3))


def banded(scores: DataFrame, keys: list[str], score: str, bands, rest: str) -> DataFrame:
    """Counts per band, widest open at the bottom, with mean and population deviation."""
    out, above = [F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("sd")], F.lit(False)
    for name, least in bands:
        here = F.col(score) >= least
        out.append(F.count_if(here & ~above).alias(name))
        above = here
    return scores.groupBy(*keys).agg(*out, F.count_if(~above).alias(rest))


def identified(outputs: DataFrame) -> DataFrame:
    """Outputs with the first 16 digits of their content's SHA-256, and where they stand in their group."""
    order = Window.partitionBy("group_id").orderBy("ordinal")
    return outputs.select("group_id", "ordinal", F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.row_number().over(order).alias("place"))
