"""Keyed state on a stream: late and repeated events, restarts, and twins over tables."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from verdigris.streaming import monitoring, stateful

START = dt.datetime(2024, 1, 1)


def arrivals(n, seed, make):
    """Events in order of arrival: up to 20 minutes late, some twice, and one each of what is no event."""
    rng = random.Random(seed)
    events = [(f"e{i:04}", START + dt.timedelta(seconds=30 * i + rng.randrange(30), milliseconds=rng.randrange(1000)), *make(rng)) for i in range(n)]
    order = [(t + dt.timedelta(minutes=rng.randrange(20)), e) for e in events for t in [e[1]]] + [(e[1] + dt.timedelta(minutes=19), e) for e in events[::7]]
    odd = (None, START, *make(rng)), ("x", None, *make(rng)), ("y", START, None, None)
    return events, [e for _, e in sorted(order, key=lambda x: (x[0], x[1][0]))][:-1] + list(odd)


def run(spark, tmp_path, schema, slices, make):
    """One run of the stream for each slice, each a restart from the checkpoint."""
    stateful.use_rocksdb(spark)
    at = str(tmp_path)
    for part in slices:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = make(monitoring.read_stream(spark, f"{at}/in", spark.createDataFrame([], schema).schema, 1))
        monitoring.write_stream(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def cut(rows, n):
    return [rows[len(rows) * k // n : len(rows) * (k + 1) // n] for k in range(n)]


def passed(events, minutes):
    mark = max(e[1] for e in events) - dt.timedelta(minutes=minutes)
    return [e for e in events if e[1] <= mark]


def plain_states(events, most):
    state, out = {}, Counter()
    for event, ts, job, action in sorted(events, key=lambda e: (e[1], e[0])):
        before, tries = state.get(job, ("", 0))
        after = stateful.ADMITTED.get((before, action))
        ok = after is not None and not (action == "retry" and tries >= most)
        state[job] = (after, tries + (action == "retry")) if ok else (before, tries)
        out[job, event, action, before, *state[job], ok] += 1
    return out


JOB = "event_id string, ts timestamp, job_id string, action string"
PICK = ["job_id", "event_id", "action", "before", "after", "retries", "accepted"]


def test_job_states_of_late_repeated_events_over_restarts(spark, tmp_path):
    actions = ["submit", "start", "complete", "fail", "fail", "retry", "cancel", "explode"]
    events, came = arrivals(400, 1, lambda rng: (rng.choice(["hot", "hot", "a", "b"]), rng.choice(actions)))
    out = run(spark, tmp_path, JOB, cut(came, 3), lambda s: stateful.job_transitions(s, "40 minutes", 2))
    got = Counter(tuple(r[c] for c in PICK) for r in out.collect())
    assert got == plain_states(passed(events, 40), 2)
    assert {r[4] for r in got} >= {"completed", "failed", "cancelled"} and {r[-1] for r in got} == {True, False}
    table = stateful.job_transitions(spark.createDataFrame(came, JOB), most_retries=2)
    assert Counter(tuple(r[c] for c in PICK) for r in table.collect()) == plain_states(events, 2)


def test_retries_end(spark):
    rows = [(f"{i:02}", START + dt.timedelta(seconds=i), "j", a) for i, a in enumerate(["submit", *["start", "fail", "retry"] * 5])]
    out = stateful.job_transitions(spark.createDataFrame(rows, JOB)).orderBy("ts").collect()
    assert [(r["after"], r["retries"], r["accepted"]) for r in out][-4:] == [("failed", 3, False)] * 4


def test_workers_fail_in_silence(spark, tmp_path):
    schema = "event_id string, ts timestamp, worker_id int, status string"
    events, came = arrivals(300, 2, lambda rng: (rng.randrange(4), rng.choice(["idle", "idle", "busy", "busy", "failed", "offline"])))
    gap = [e for e in events if not dt.timedelta(minutes=40) < e[1] - START < dt.timedelta(minutes=60)]
    came = [e for e in came if e in gap or e[0] in (None, "x", "y")]
    out = run(spark, tmp_path, schema, cut(came, 3), lambda s: stateful.worker_changes(s, "30 minutes", 180_000))
    mark = max(e[1] for e in gap) - dt.timedelta(minutes=30)
    table = stateful.worker_changes(spark.createDataFrame(passed(gap, 30), schema), timeout_ms=180_000, as_of=F.lit(mark))
    pick = lambda df: Counter((r["worker_id"], r["ts"], r["change"]) for r in df.collect())
    assert pick(out) == pick(table)
    want, heard = Counter(), {}
    for _, ts, worker, status in sorted(passed(gap, 30), key=lambda e: (e[1], e[0])):
        ts = ts.replace(microsecond=ts.microsecond // 1000 * 1000)
        if worker in heard and ts - heard[worker] >= dt.timedelta(minutes=3):
            want[worker, heard.pop(worker) + dt.timedelta(minutes=3), "failed"] += 1
        if status in stateful.WELL:
            want[worker, ts, "joined"] += worker not in heard
            heard[worker] = ts
        elif heard.pop(worker, None):
            want[worker, ts, "failed"] += 1
    for worker, ts in heard.items():
        want[worker, ts + dt.timedelta(minutes=3), "failed"] += ts + dt.timedelta(minutes=3) <= mark
    assert pick(table) == +want


def test_history_is_bounded_and_survives_restarts(spark, tmp_path):
    schema = "event_id string, ts timestamp, job_id string, queue string"
    events, came = arrivals(500, 3, lambda rng: (f"j{rng.randrange(10**6)}", rng.choice(["q", "q", "r"])))
    out = run(spark, tmp_path, schema, cut(came, 3), lambda s: stateful.completed_history(s, "queue", 20, 3))
    held = out.groupBy("key", "part").agg(F.sum("change").alias("n")).agg(F.max("n")).first()[0]
    assert held == 20
    got = {(r["key"], r["job_id"], r["place"]) for r in stateful.latest_of(out, 20).where("key IS NOT NULL").collect()}
    want = set()
    for q in "qr":
        jobs = sorted({(e[1].replace(microsecond=e[1].microsecond // 1000 * 1000), e[2]) for e in came if e[1] and e[2] and e[3] == q}, reverse=True)
        want |= {(q, j, k + 1) for k, (_, j) in enumerate(jobs[:20])}
    assert got == want
