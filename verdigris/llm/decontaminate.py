"""Benchmark decontamination with a hash set of test windows; built-in functions only.

Each benchmark item's normalised words give its windows: every run of ten words, or the whole item
where it has fewer. Their hashes set places in a table of bytes that every task has as a literal, of
``MOST_PLACES`` bytes at most. A document's windows, of the lengths that occur in the benchmark, are hashed
as they stand and looked up there; nothing else is made of the others. What is found is joined with the
windows themselves, so each hit is verified. What hits cover is then counted once per word, per document.

The windows are broadcast up to ``MOST_BROADCAST`` bytes, which are counted first; beyond, the join is a
shuffle of the windows that passed the table.

Defined results: null and empty texts have no words and no hits; repeated rows are judged each; an
item without words or a null text has no windows; a null item_id is the item named ``null``, and one with
that name is the same item; an empty benchmark leaves all documents clean; long texts are read whole; extra
columns pass through ``drop_contaminated`` untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import checkpoint

WINDOW = 10
#: Bytes of windows, with their items, that are broadcast; and of the table that is looked up first.
MOST_BROADCAST, MOST_PLACES = 64 << 20, 1 << 22
#: Keys of contaminated documents that are broadcast.
MOST_KEYS = 1_000_000
#: All of ASCII but letters and digits.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Runs of letters, digits and all that isn't ASCII, with A-Z lower-cased."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + BETWEEN, string.ascii_lowercase + " " * len(BETWEEN)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def window_at(words: Column, start: Column, length: int) -> Column:
    return F.concat_ws(" ", F.slice(words, start, length))


def starts(n_words: Column, length: int) -> Column:
    """1 .. n_words - length + 1, or nothing."""
    return F.when(n_words >= length, F.sequence(F.lit(1), n_words - length + 1)).otherwise(F.array().cast("array<int>"))


def test_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, window, length, items): each distinct window and the sorted names of the items it is in."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("words"))
    sized = named.withColumn("n", F.size("words")).where("n > 0")
    full = F.transform(starts(F.col("n"), WINDOW), lambda i: F.slice("words", i, WINDOW))
    own = F.when(F.col("n") < WINDOW, F.array("words")).otherwise(full)
    return (
        sized.select("item", F.least("n", F.lit(WINDOW)).alias("length"), F.explode(own).alias("run"))
        .select("item", "length", F.xxhash64("run").alias("hash"), F.concat_ws(" ", "run").alias("window"))
        .groupBy("hash", "window", "length")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def places(tests: DataFrame, windows: int) -> bytes:
    """One byte for each place, 1 where some window's hash falls; eight places a window, if there is room."""
    n = 1 << 10
    while n < min(8 * windows, MOST_PLACES):
        n *= 2
    table = bytearray(n)
    for at in tests.select(F.pmod("hash", F.lit(n)).cast("int").alias("at")).distinct().toArrow().column("at").to_pylist():
        table[at] = 1
    return bytes(table)


def covered(hits: Column) -> Column:
    """Words inside the union of (pos, length) runs, sorted by pos."""
    step = lambda acc, h: F.struct(
        F.greatest(acc["upto"], h["pos"] + h["length"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0), h["pos"] + h["length"] - F.greatest(acc["upto"], h["pos"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(hits), F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), step, lambda acc: acc["n"].cast("long"))


def judge(docs: DataFrame, benchmark: DataFrame, carry: list[str]) -> DataFrame:
    """One row per row of ``docs``: the columns of ``carry``, n_words, n_hit, n_items, items_sha256,
    contaminated, and ``spans`` (the runs of hit words, as pos from 1 and length)."""
    tests = checkpoint(test_windows(benchmark))
    held = F.octet_length("window") + F.aggregate("items", F.lit(64), lambda n, item: n + 32 + F.octet_length(item))
    found = tests.groupBy("length").agg(F.count("*").alias("n"), F.sum(held).alias("bytes")).collect()  # at most ten rows
    table = places(tests, sum(r["n"] for r in found))
    lookup = tests.select("window", "length", "items")
    if sum(r["bytes"] for r in found) <= MOST_BROADCAST:
        lookup = F.broadcast(lookup)
    row = docs.select(*carry, F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("words"))
    row = row.withColumn("n_words", F.size("words"))

    def candidates(length: int) -> Column:
        place = lambda i: F.pmod(F.xxhash64(F.slice("words", i, length)), F.lit(len(table)))
        known = F.filter(starts(F.col("n_words"), length), lambda i: F.substr(F.lit(table), (place(i) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01"))
        return F.transform(known, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("length"), window_at(F.col("words"), i, length).alias("window")))

    # a document without candidates keeps a row, whose key is its own and no window's: keys of length 0 are none
    own = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("length"), F.col("row").cast("string").alias("window")))
    spread = row.select(*carry, "row", "n_words", F.inline(F.concat(own, *map(candidates, sorted(r["length"] for r in found)))))
    hits = spread.join(lookup, ["window", "length"], "left").where("length = 0 OR items IS NOT NULL")
    run = F.when(F.col("length") > 0, F.struct("pos", "length"))
    judged = hits.groupBy("row", "n_words", *carry).agg(
        F.array_sort(F.collect_list(run)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return judged.select(
        *carry,
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return judge(docs, benchmark, ["doc_id"]).drop("spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns.

    The keys of contaminated ones are counted; up to ``MOST_KEYS`` are broadcast, and the rows stay where
    they are read. Beyond, both are shuffled by the key.
    """
    key = [F.xxhash64("text").alias("_hash"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")]
    keyed = docs.select(F.struct("*").alias("_row"), *key, "text")
    bad = checkpoint(judge(keyed.select("_hash", "_id", "text"), benchmark, ["_hash", "_id"]).where("contaminated").select("_hash", "_id").distinct())
    if bad.count() <= MOST_KEYS:
        bad = F.broadcast(bad)
    return keyed.join(bad, ["_hash", "_id"], "left_anti").select("_row.*")
