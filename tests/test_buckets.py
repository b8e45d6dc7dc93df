"""A bucket of keys costs a few calls of state, however many its keys are."""

import datetime as dt
import random
from collections import Counter

import pandas as pd

from tests.test_stateful import plain_states
from verdigris.streaming import stateful

EPOCH = dt.datetime(1970, 1, 1)


class State:
    """One variable of one bucket; counts its calls."""

    def __init__(self):
        self.held, self.calls = [], 0

    def called(self):
        self.calls += 1
        return self

    def exists(self):
        return bool(self.called().held)

    def clear(self):
        self.called().held = []

    def appendValue(self, value):
        self.called().held.append(value)


class ListOf(State):
    def get(self):
        return iter(list(self.called().held))


class ValueOf(State):
    def get(self):
        return self.called().held[0]

    def update(self, value):
        self.called().held = [value]


class Handle:
    def __init__(self):
        self.states, self.timers, self.mark = [], set(), 0

    def kept(self, state):
        self.states.append(state)
        return state

    def getListState(self, name, schema):
        return self.kept(ListOf())

    def getValueState(self, name, schema):
        return self.kept(ValueOf())

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


def replayed(processor, columns, batches, delay):
    """Rows that come out of a bucket, and the most calls of state that a batch made."""
    handle, out, most = Handle(), [], 0
    processor.init(handle)
    for batch in [*batches, []]:
        before = sum(s.calls for s in handle.states)
        if batch:
            assert not list(processor.handleInputRows((0,), iter([pd.DataFrame(batch, columns=columns)]), handle))
        due = {t for t in handle.timers if t <= handle.mark}
        handle.timers -= due
        for _ in sorted(due):
            out += [r for part in processor.handleExpiredTimer((0,), handle, None) for r in part.itertuples(index=False, name=None)]
        most = max(most, sum(s.calls for s in handle.states) - before)
        handle.mark = max(handle.mark, max((r[2] for r in batch), default=0) - delay)
    return out, most


def test_many_jobs_of_a_bucket_are_few_calls_of_state():
    rng = random.Random(4)
    events = [(rng.randrange(1500), f"e{k:05}", 1000 * k, rng.choice(["submit", "start", "complete", "fail", "retry", "cancel"])) for k in range(6000)]
    came = sorted(events, key=lambda e: e[2] + rng.randrange(400_000))
    batches = [came[k : k + 1000] + came[k : k + 50] for k in range(0, 6000, 1000)]
    out, most = replayed(stateful.Jobs(3), ["job_id", "event_id", "ts", "what"], batches, 1_000_000)
    mark = max(e[2] for e in events) - 1_000_000
    got = Counter((r[0], r[1], r[3], *r[4:]) for r in out)
    assert got == plain_states([(e, EPOCH + dt.timedelta(milliseconds=t), j, a) for j, e, t, a in events if t <= mark], 3)
    assert most <= 12


def test_many_workers_of_a_bucket_are_few_calls_of_state():
    rng = random.Random(5)
    beats = [(rng.randrange(1500), f"e{k:05}", 1000 * k, rng.choice(["idle", "busy", "busy", "failed"])) for k in range(6000)]
    came = sorted(beats, key=lambda e: e[2] + rng.randrange(400_000))
    out, most = replayed(stateful.Workers(900_000), ["worker_id", "event_id", "ts", "what"], [came[k : k + 1000] + came[k : k + 50] for k in range(0, 6000, 1000)], 1_000_000)
    mark, heard, want = max(e[2] for e in beats) - 1_000_000, {}, Counter()
    for worker, _, ts, status in beats:
        if ts > mark:
            break
        if worker in heard and ts - heard[worker] >= 900_000:
            want[worker, heard.pop(worker) + 900_000, "failed"] += 1
        if status in stateful.WELL:
            want[worker, ts, "joined"] += worker not in heard
            heard[worker] = ts
        elif heard.pop(worker, None) is not None:
            want[worker, ts, "failed"] += 1
    for worker, ts in heard.items():
        want[worker, ts + 900_000, "failed"] += ts + 900_000 <= mark
    assert Counter(out) == +want
    assert most <= 12
