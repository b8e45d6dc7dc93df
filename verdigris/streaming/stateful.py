"""Jobs, workers and histories as keyed state on a stream, with a twin of each over a table.

What comes in may be late and may come more than once. Events wait in the state of their key's bucket until the watermark has passed
them, and are then applied in order of (ts, event_id): results don't depend on the order of arrival, as long as nothing is later than
``delay``. Events that repeat an id and time count once. State is kept by Spark's RocksDB store (``use_rocksdb``), and survives a restart
from the checkpoint.

Null keys, times, ids or actions are no events and are left out; actions that there are not are refused like any
other that a job's state does not admit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from verdigris.functions.ranges import ordered_fold

#: What a job's state admits. A job that is not known has the state "".
ADMITTED = {
    ("", "submit"): "pending", ("pending", "start"): "running", ("running", "complete"): "completed", ("running", "fail"): "failed",
    ("pending", "cancel"): "cancelled", ("running", "cancel"): "cancelled", ("failed", "retry"): "pending",
}
#: A worker in one of these states is well, if it was heard of lately.
WELL = ("idle", "busy")
MOST_RETRIES, TIMEOUT_MS, KEPT = 3, 60_000, 1000
#: Keys are dealt over so many buckets, which hold for as long as a checkpoint does; a bucket's rows wait in chunks of so many.
BUCKETS, ROWS_IN_CHUNK = 512, 10_000


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which state with timers asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def moved(state: tuple[str, int], action: str, most_retries: int) -> tuple[str, int] | None:
    """The (status, retries) after an action, or None where it is refused."""
    status, retries = state
    after = ADMITTED.get((status, action))
    if after is None or action == "retry" and retries >= most_retries:
        return None
    return after, retries + (action == "retry")


class InOrder(StatefulProcessor):
    """Keeps a bucket's rows until the watermark has passed them, then hands them on in order, each once.

    A bucket is many keys: a call of state costs far more than a row, so rows wait in chunks and the states of a bucket's keys lie together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.now = handle.getValueState("now", "states binary")

    def wait(self, rows: list[tuple]) -> None:
        for first in range(0, len(rows), ROWS_IN_CHUNK):
            self.waiting.appendValue((pickle.dumps(rows[first : first + ROWS_IN_CHUNK]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.wait([r for part in rows for r in zip(part[self.names[0]].tolist(), part["ts"].astype("int64").tolist(), part["event_id"].tolist(), part["what"].tolist())])
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)  # when the watermark next moves
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = {r for (chunk,) in self.waiting.get() for r in pickle.loads(chunk)} if self.waiting.exists() else set()
        due = sorted((r for r in held if r[1] <= passed), key=lambda r: r[1:])
        rest = [r for r in held if r[1] > passed] if due else held
        if due:
            self.waiting.clear()
            self.wait(rest)
        now = pickle.loads(self.now.get()[0]) if self.now.exists() else {}
        out = self.applied(now, due, passed)
        if due or out:
            self.now.update((pickle.dumps(now),))
        if rest or self.timed and now:
            self.handle.registerTimer(passed + 1)
        for first in range(0, len(out), ROWS_IN_CHUNK):
            yield pd.DataFrame(out[first : first + ROWS_IN_CHUNK], columns=self.names)

    def close(self) -> None:
        pass


class Jobs(InOrder):
    """Every event, with the state before and after it and whether it was admitted."""

    timed, names = False, ["job_id", "event_id", "ts", "action", "before", "after", "retries", "accepted"]

    def __init__(self, most_retries: int):
        self.most_retries = most_retries

    def applied(self, now: dict, due: list[tuple], passed: int) -> list[tuple]:
        out = []
        for job, ts, event, action in due:
            state = now.get(job, ("", 0))
            after = moved(state, action, self.most_retries)
            out.append((job, event, ts, action, state[0], *(after or state), after is not None))
            if after:
                now[job] = after
        return out


class Workers(InOrder):
    """Changes of workers: joined, and failed when silent for the timeout or not well. Only workers that are up have a state: when they were heard of."""

    timed, names = True, ["worker_id", "ts", "change"]

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def applied(self, now: dict, due: list[tuple], passed: int) -> list[tuple]:
        out = []
        for worker, ts, _, status in due:
            heard = now.pop(worker, None)
            if heard is not None and ts - heard >= self.timeout_ms:
                out.append((worker, heard + self.timeout_ms, "failed"))
                heard = None
            if status in WELL:
                out += [(worker, ts, "joined")] if heard is None else []
                now[worker] = ts
            elif heard is not None:
                out.append((worker, ts, "failed"))
        for worker, heard in list(now.items()):
            if heard + self.timeout_ms <= passed:
                out.append((worker, heard + self.timeout_ms, "failed"))
                del now[worker]
        return out


def millis(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _rows(events: DataFrame, key: str, what: str) -> DataFrame:
    kept = events.select(key, F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("at"), F.col(what).cast("string").alias("what")).dropna()
    return kept.withColumn("ts", F.unix_millis("at"))


def _dealt(rows: DataFrame, key: str, delay: str):
    """A stream's rows by their key's bucket."""
    return rows.withWatermark("at", delay).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).groupBy("_bucket")


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis("ts"))


def job_transitions(events: DataFrame, delay: str = "1 hour", most_retries: int = MOST_RETRIES) -> DataFrame:
    """(job_id, event_id, ts, action, before, after, retries, accepted) of each event (job_id, event_id, ts, action). On a
    stream an event's row comes when the watermark, ``delay`` behind the latest event, has passed it. On a table all
    have theirs; a job's events are then folded in ranges of time, so a hot job is many tasks' work."""
    kind = events.schema["job_id"].dataType.simpleString()
    schema = f"job_id {kind}, event_id string, ts long, action string, before string, after string, retries int, accepted boolean"
    rows = _rows(events, "job_id", "action")
    if events.isStreaming:
        return _typed(_dealt(rows, "job_id", delay).transformWithStateInPandas(Jobs(most_retries), schema, "Append", "EventTime"))
    once = rows.drop("at").distinct().withColumnRenamed("what", "action")
    states = [(s, r) for s in ("", *dict.fromkeys(ADMITTED.values())) for r in range(most_retries + 1)]
    number = {s: k for k, s in enumerate(states)}

    def step(k: int, row: dict) -> int:
        after = moved(states[k], row["action"], most_retries)
        return k if after is None else number[after]

    folded = ordered_fold(once, ["job_id"], ["ts", "event_id"], len(states), number["", 0], step)
    name = F.array(*[F.lit(s) for s, _ in states])
    tries = F.array(*[F.lit(r) for _, r in states])
    was, now = F.col("_before") + 1, F.col("_after") + 1
    return _typed(folded.select(
        "job_id", "event_id", "ts", "action", F.element_at(name, was).alias("before"), F.element_at(name, now).alias("after"), F.element_at(tries, now).alias("retries"),
        (F.col("_before") != F.col("_after")).alias("accepted"),  # each admitted action changes the status
    ))


def worker_changes(heartbeats: DataFrame, delay: str = "1 hour", timeout_ms: int = TIMEOUT_MS, as_of: Column | None = None) -> DataFrame:
    """(worker_id, ts, change) from heartbeats (worker_id, event_id, ts, status): ``joined`` at the first one that is well and at
    the first after a failure, ``failed`` at one that is not well, or when ``timeout_ms`` have gone by in silence. On a table, silence
    after the last heartbeat is judged at ``as_of``, or not at all."""
    kind = heartbeats.schema["worker_id"].dataType.simpleString()
    rows = _rows(heartbeats, "worker_id", "status")
    if heartbeats.isStreaming:
        return _typed(_dealt(rows, "worker_id", delay).transformWithStateInPandas(Workers(timeout_ms), f"worker_id {kind}, ts long, change string", "Append", "EventTime"))
    order = Window.partitionBy("worker_id").orderBy("ts", "event_id")
    well, end = F.col("what").isin(*WELL), F.lit(None).cast("long") if as_of is None else F.unix_millis(as_of.cast("timestamp"))
    seen = rows.drop("at").distinct().withColumns({
        "_well": well, "_before": F.lag(well).over(order), "_gap": F.col("ts") - F.lag("ts").over(order), "_next": F.coalesce(F.lead("ts").over(order), end),
    })
    new = F.col("_before").isNull() | ~F.col("_before") | (F.col("_gap") >= timeout_ms)
    change = lambda on, ts, name: F.when(on, F.struct(ts.alias("ts"), F.lit(name).alias("change")))
    changes = F.array(
        change(F.col("_well") & new, F.col("ts"), "joined"),
        change(~F.col("_well") & F.col("_before") & (F.col("_gap") < timeout_ms), F.col("ts"), "failed"),
        change(F.col("_well") & (F.col("_next") - F.col("ts") >= timeout_ms), F.col("ts") + timeout_ms, "failed"),
    )
    return _typed(seen.select("worker_id", F.inline(F.filter(changes, lambda c: c.isNotNull()))))


class History(StatefulProcessor):
    """The latest ``keep`` ended jobs of a group; tells which come in and which go."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "ts long, job_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = set(map(tuple, self.kept.get())) if self.kept.exists() else set()
        now = set(before)
        for part in rows:
            now.update(zip(part["ts"].astype("int64").tolist(), part["job_id"].tolist()))
            if len(now) > self.keep:
                now = set(sorted(now, reverse=True)[: self.keep])
        if now != before:
            self.kept.put(sorted(now))
            out = [(*key, ts, job, 1) for ts, job in sorted(now - before)] + [(*key, ts, job, -1) for ts, job in sorted(before - now)]
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def completed_history(ended: DataFrame, key: str | None = None, keep: int = KEPT, parts: int = 16) -> DataFrame:
    """Of a stream of ended jobs (job_id, ts, and ``key`` if histories are by group), what comes into each history and what
    goes out of it, as rows (key, part, ts, job_id, change) with a change of 1 or -1. A history is dealt over ``parts`` by the job's hash,
    each of which keeps ``keep``, so that one group is not one task's; ``latest_of`` puts it together. The latest
    stay, of equal times the larger id: whatever comes late or twice, the history is the same."""
    part = F.pmod(F.xxhash64(F.col("job_id").cast("string")), F.lit(parts)).cast("int")
    rows = ended.select((F.col(key) if key else F.lit("all")).alias("key"), part.alias("part"), millis().alias("ts"), F.col("job_id").cast("string").alias("job_id")).dropna(subset=["ts", "job_id"])
    kind = rows.schema["key"].dataType.simpleString()
    history = History(keep)
    history.names = ["key", "part", "ts", "job_id", "change"]
    return rows.groupBy("key", "part").transformWithStateInPandas(history, f"key {kind}, part int, ts long, job_id string, change int", "Append", "None")


def latest_of(changes: DataFrame, keep: int = KEPT) -> DataFrame:
    """(key, ts, job_id, place) of the histories that ``completed_history`` told the changes of."""
    held = changes.groupBy("key", "ts", "job_id").agg(F.sum("change").alias("n")).where("n > 0").drop("n")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("job_id")))  # of ``parts`` * ``keep`` rows at most
    return _typed(held.withColumn("place", place).where(F.col("place") <= keep))
