"""Sorted ranges and what is carried over their borders, against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verdigris.functions.percentiles import percentiles
from verdigris.functions.ranges import ordered_fold, ranged, tied
from verdigris.functions.running import running_sum
from verdigris.operators import inference, ranking


@pytest.fixture
def many_ranges(spark):
    """Small tables in 7 ranges, as large ones would be."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield 7
    for k, v in held.items():
        spark.conf.set(k, v)


def values(n, seed=1):
    """A hot group, a null one and small ones, all values distinct."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + [None, "a", "b"]), rng.random()) for _ in range(n)]


def test_a_hot_group_is_cut(spark, many_ranges):
    rows = values(2000)
    fixed = ranged(spark.createDataFrame(rows, "g string, v double"), "g", "v")
    assert fixed.where("g = 'hot'").select("_range").distinct().count() >= 4


def test_running_sums_of_groups(spark, many_ranges):
    rows = [(g, v, i % 5, i) for i, (g, v) in enumerate(values(1500))]
    rows += [("hot", 0.5, 1, 2000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, w long, i long")
    got = {r["i"]: r["s"] for r in running_sum(df, "v", F.col("w"), "s", "i", keys=("g",)).collect()}
    want, at = {}, defaultdict(int)
    for g, _, w, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[3])):
        at[g] += w
        want[i] = at[g]
    assert got == want
    whole = running_sum(df, "v", F.col("w"), "s", "i")
    assert whole.columns == [*df.columns, "s"] and whole.agg(F.max("s")).first()[0] == sum(r[2] for r in rows)


@pytest.mark.parametrize("keys", [["g"], []])
def test_percentiles_of_hot_groups(spark, many_ranges, keys):
    rows = values(3000) + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"low": ("rank", 0.0), "half": ("middle", 0.5), "p95": ("nearest", 0.95), "p99": ("floor", 0.99), "top": ("rank", 1.0)}
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g if keys else None].append(v)
    got = {(r["g"] if keys else None): tuple(r[n] for n in wanted) for r in percentiles(df, keys, "v", wanted).collect()}

    def want(v):
        v, n = sorted(v), len(v)
        return v[0], (v[(n - 1) // 2] + v[n // 2]) / 2, v[max(0, -(-95 * n // 100) - 1)], v[min(int(n * 0.99), n - 1)], v[-1]

    assert got == {g: want(v) for g, v in groups.items()}


def brute_ties(v, within):
    out, first = {}, None
    for x in sorted(v):
        if first is None or x - first >= within:
            first = x
        out[x] = first
    return out


@pytest.mark.parametrize("step,n", [(0.3, 400), (0.01, 900), (0.0001, 200), (5.0, 50)])
def test_ties_are_chained_over_borders(spark, many_ranges, step, n):
    rng = random.Random(3)
    v, x = [], 0.0
    for _ in range(n):
        x += rng.random() * step
        v.append(x)
    got = tied(spark.createDataFrame([(x, 1) for x in v], "v double, c int"), "v", 1.0)
    assert {r["v"]: r["_first"] for r in got.collect()} == brute_ties(v, 1.0)


def test_mann_whitney_ties_within_tolerance(spark, many_ranges):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(40) + rng.randrange(30) * 9e-12) for _ in range(500)] + [("a", None), ("b", float("nan")), ("c", 1.0)]
    kept = sorted((v, s) for s, v in rows if s in "ab" and v is not None and v == v)
    ranks, i = [], 0
    while i < len(kept):
        j = i
        while j < len(kept) and kept[j][0] - kept[i][0] < 1e-10:
            j += 1
        ranks += [(i + 1 + j) / 2] * (j - i)
        i = j
    n1 = sum(s == "a" for _, s in kept)
    u1 = sum(r for r, (_, s) in zip(ranks, kept) if s == "a") - n1 * (n1 + 1) / 2
    got = inference.mann_whitney(spark.createDataFrame(rows, "s string, v double"), "s", "a", "b", "v").first()
    assert (got["n1"], got["n2"], got["u"]) == (n1, len(kept) - n1, min(u1, n1 * (len(kept) - n1) - u1))
    assert len(set(ranks)) < len({v for v, _ in kept})


def test_folds_of_hot_keys(spark, many_ranges):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 5 + [None, "a"]), i * 10 + rng.randrange(10), rng.choice("xyz")) for i in range(1200)]
    moves = {(s, x): rng.randrange(4) for s in range(4) for x in "xyz"}
    got = ordered_fold(spark.createDataFrame(rows, "k string, t long, x string"), ["k"], ["t"], 4, 2, lambda s, row: moves[s, row["x"]])
    want, state = Counter(), {}
    for k, t, x in sorted(rows, key=lambda r: r[1]):
        before = state.get(k, 2)
        state[k] = moves[before, x]
        want[k, t, x, before, state[k]] += 1
    assert Counter(map(tuple, got.collect())) == want


def plain_profile(seen, w=0.1):
    import math

    q, l = seen[0][1], seen[0][2]
    for _, x, y in seen[1:]:
        q, l = q * (1 - w) + x * w, math.floor(l * (1 - w) + y * w)
    return round(q, 6), int(l), len(seen)


@pytest.mark.parametrize("calm", [False, True])
def test_profiles_of_a_hot_model(spark, many_ranges, calm):
    """Where latencies don't change, what comes from below stays below, and ranges have to be folded again."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, i % 3, rng.random(), 100.0 + (0 if calm and i > 5 else rng.randrange(4000))) for i in range(1500)]
    rows += [("hot", 3, 9, None, 5.0), ("a", 4, 9, 0.5, None), ("a", 5, 9, 0.5, 10.0)]
    again = []
    got = {r["model"]: (r["quality"], r["latency_ms"], r["samples"]) for r in ranking.smoothed_profiles(spark.createDataFrame(rows, "model string, ts long, tie long, quality double, latency double"), reruns=again).collect()}
    by = defaultdict(list)
    for m, t, tie, q, l in sorted(rows, key=lambda r: r[1:3]):
        if q is not None and l is not None:
            by[m].append((t, q, l))
    assert got == {m: plain_profile(seen) for m, seen in by.items()}
    assert (len(again) > 2) == calm, again  # short stretches don't always meet
