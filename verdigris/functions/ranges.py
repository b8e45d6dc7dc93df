"""Tables cut into sorted ranges, and folds in their order that no task sees whole.

``ranged`` sorts a table once, range by range: Spark samples the borders, adaptive execution joins small ranges, and a
hot key is cut like anything else where its order goes on. The result is checkpointed, so borders stay what they are however often it is
read, and whatever is lost.

``carried`` walks what is carried from one range to the next. A range tells of its first and its last key only, as what lies
between begins and ends in it: two lines a range reach the driver, whatever the table's size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.storage import checkpoint


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in the order of ``by``, a range of it in each partition, with the range's number in ``_range``. Rows that are
    equal in all of ``by`` lie in one range."""
    return checkpoint(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, tuple, list[dict]]]:
    """(whether a key begins, the key, rows) of sorted rows; a key's rows come batch by batch."""
    now = None
    for batch in batches:
        held: list[dict] = []
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != tuple(held[-1][k] for k in keys):
                was = tuple(held[-1][k] for k in keys)
                yield was != now, was, held
                now, held = was, []
            held.append(row)
        if held:
            was = tuple(held[-1][k] for k in keys)
            yield was != now, was, held
            now = was


def border_lines(fixed: DataFrame, keys: list[str], begun: Callable[[], Any], fold: Callable[[Any, list[dict]], Any]) -> list[tuple]:
    """(range, key, line) of the first and of the last key of each range, in order. A line is what ``fold`` makes of a key's
    rows in a range, beginning with ``begun()``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []
        at = None
        for new, key, rows in runs(batches, keys):
            at = rows[0]["_range"]
            if new:
                found = [*found[:1], [key, begun()]]
            found[-1][1] = fold(found[-1][1], rows)
        lines = [(at, k, *line) for k, line in enumerate(found)]
        if lines:
            yield pa.RecordBatch.from_pydict({"at": pa.array([at] * len(lines), pa.int32()), "line": [pickle.dumps(x) for x in lines]})

    return [(at, key, line) for at, _, key, line in sorted((pickle.loads(r["line"]) for r in fixed.mapInArrow(each, "at int, line binary").collect()), key=lambda x: x[:2])]


def carried(lines: list[tuple], combine: Callable[[int, Any, Any], Any]) -> tuple[dict[int, Any], set[int]]:
    """What each range's first key has gathered before it, for ranges that go on with a key ({range: state}), and the ranges
    whose last key goes on in the next. ``combine(range, state or None, line)`` gives the state after a line."""
    starts, going_on, key, state, before = {}, set(), None, None, None
    for at, now, line in lines:
        if key is not None and now == key[0] and at != before:
            starts[at] = state
            going_on.add(before)
        else:
            state = None
        state, key, before = combine(at, state, line), (now,), at
    return starts, going_on


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], states: int, first: int, step: Callable[[int, dict], int]) -> DataFrame:
    """``rows`` with ``_before`` and ``_after``, the numbers of the states that each began and ended in, in the order of ``order``
    within a key. ``step`` gives the state after a row; there are ``states`` of them, few, and a key begins in ``first``. What a
    range makes of every state is worked out before it is known in which one it begins, so a hot key is many tasks'
    work; a batch is in memory at a time."""
    names, fixed = rows.columns, ranged(rows, *keys, *order)

    def through(held: list[int], part: list[dict]) -> list[int]:
        for row in part:
            after = {s: step(s, row) for s in set(held)}
            held = [after[s] for s in held]
        return held

    lines = border_lines(fixed, keys, lambda: list(range(states)), through)
    starts, _ = carried(lines, lambda at, state, line: line[first if state is None else state])
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, first
        for batch in batches:
            before, after = [], []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if now is None or key != now:
                    state = shared.value.get(row["_range"], first) if now is None else first
                    now = key
                before.append(state)
                state = step(state, row)
                after.append(state)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(before, pa.int32()), pa.array(after, pa.int32())], names=[*names, "_before", "_after"])

    whole = [T.StructField(c, T.IntegerType()) for c in ("_before", "_after")]
    return fixed.mapInArrow(replayed, T.StructType([*rows.schema.fields, *whole]))


def tied(counts: DataFrame, by: str, within: float, into: str = "_first") -> DataFrame:
    """``counts`` (a row for each value of ``by``) with the first value of each one's group of ties: in rising order, a group takes in
    what is nearer than ``within`` to its first value, and the next value begins another. A group may go on over any
    number of ranges: each range tells where it would end, by where a group that comes into it would let go, and the open
    group is carried through these. A range's values are in memory at a time."""
    fixed, names = ranged(counts, by), counts.columns

    def values(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], np.ndarray]:
        held = [b for b in batches if b.num_rows]
        return held, np.concatenate([b.column(by).to_numpy(zero_copy_only=False) for b in held]).astype(float) if held else np.zeros(0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, v = values(batches)
        if not held:
            return
        last, nxt = [0.0] * len(v), len(v)  # where the chain of groups that begins at each value begins its last one
        for i in range(len(v) - 1, -1, -1):
            while nxt > i + 1 and v[nxt - 1] - v[i] >= within:
                nxt -= 1
            last[i] = last[nxt] if nxt < len(v) else float(v[i])
        # a group from before lets go at one of the values nearer than ``within`` to the first; equal ends are one step
        steps, i = [], 0
        while i < len(v) and (i == 0 or v[i - 1] - v[0] < within):
            if not steps or steps[-1][1] != last[i]:
                steps.append([float(v[i]), last[i]])
            steps[-1][0] = float(v[i])
            i += 1
        at = held[0].column("_range")[0].as_py()
        yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "line": [pickle.dumps((float(v[-1]), steps))]})

    starts, opened = {}, None
    for at, (most, steps) in sorted((r["at"], pickle.loads(r["line"])) for r in fixed.mapInArrow(each, "at int, line binary").collect()):
        if opened is not None:
            starts[at] = opened
        if opened is None or most - opened >= within:
            opened = next((end for upto, end in steps if opened is None or upto - opened >= within), None)
    shared = counts.sparkSession.sparkContext.broadcast(starts)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first = shared.value.get(batch.column("_range")[0].as_py())
            out = []
            for v in batch.column(by).to_numpy(zero_copy_only=False).astype(float).tolist():
                if first is None or v - first >= within:
                    first = v
                out.append(first)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.float64())], names=[*names, into])

    return fixed.mapInArrow(grouped, T.StructType([*counts.schema.fields, T.StructField(into, T.DoubleType())]))
