"""Likelihood ratios, whitening and vector codes against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.test_text_operators import ODD, random_texts
from verdigris.llm import likelihood, vector_codes, whitening

NAN, INF = float("nan"), float("inf")

# op11


def brute_base(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [line for line in t.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return words, (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed)


def brute_kept(docs, trusted, s):
    h = lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "little") % (2**31 - 1)
    found = []
    for _, text in docs:
        words = brute_base(text)[0]
        found.append([h(w) % s.buckets for w in words] + [(h(a) * 1_000_003 + h(b) + 1) % s.buckets for a, b in zip(words, words[1:])])
    raw, target = Counter(), Counter()
    for (i, _), g in zip(docs, found):
        raw.update(g)
        if i in trusted:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())

    def weight(b):
        if not m:
            return 0
        share = (raw[b] + 1.0) / (n + s.buckets)
        return math.floor(math.log((target[b] + s.prior * share) / (m + s.prior) / share) * 2**20 + 0.5)

    return [sum(map(weight, g)) >= math.floor(s.threshold * 2**20) * len(g) for g in found]


def junk_and_prose():
    rng = random.Random(4)
    good = random_texts(60, 8, 200)
    junk = [" ".join(rng.choice(["%%%", "buy###", "now&&&", "free$$$"]) + str(rng.randrange(30)) for _ in range(90)) for _ in range(20)]
    lines = ["same line here\nsame line here\n other\r\n other\r\n\n\n", "a b c " * 40, "x" * 100_000, ("long text of many words " + "été 日本 ") * 3000]
    docs = list(enumerate(good + junk + lines + ODD))
    return docs + [docs[3], docs[3], docs[65], (None, good[0]), (None, None)]


def test_likelihood_is_brute_force(spark):
    docs = junk_and_prose()
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(60, 80)] + [(3, 0, None), (4, None, 1), (None, 1, 1), (900, 1, 1)]
    s = likelihood.Settings(buckets=49_999, prior=100, threshold=0.3)
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, _m int, total int, good int").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = likelihood.report(df, table, s).collect()
    trusted = {i for i in range(60) if i != 3 and zlib.crc32(str(i).encode()) % 5}
    verdicts = brute_kept(docs, trusted, s)
    want = Counter((i, *brute_base(t)[1], kept and not brute_base(t)[1][-1]) for (i, t), kept in zip(docs, verdicts))
    assert Counter(map(tuple, rows)) == want
    assert {False, True} == {r["kept"] for r in rows if not r["base_failed"]}
    kept = likelihood.keep(df, likelihood.trusted_rows(table), s)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((i, t) for (i, t), k in zip(docs, verdicts) if k and not brute_base(t)[1][-1])


def test_likelihood_without_trusted_rows_or_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 10 + " ".join(map(str, range(60)))), (2, "few words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["kept"] for r in likelihood.report(docs, none).collect()} == {1: True, 2: False}
    assert likelihood.report(docs.limit(0), none).collect() == []


def test_likelihood_shuffles_many_trusted_ids_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(40, 5, 120))], "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    first = likelihood.train(docs, trusted)
    monkeypatch.setattr(likelihood, "MOST_BROADCAST_IDS", 3)
    assert (likelihood.train(docs, trusted) == first).all() and first.any()


# op12


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, x, label, 1, "s") for i, x, label in rows], f"vec_id long, embedding array<{kind}>, label int, _x int, state string").repartition(3)


def brute_moments(rows):
    kept = [(i, [math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in x]) for i, x, _ in rows]
    points = sorted({tuple(x) for _, x in kept})
    n, d = len(points), len(points[0])
    sums = [sum(p[k] for p in points) for k in range(d)]
    v = [[float(Fraction(n * sum(p[a] * p[b] for p in points) - sums[a] * sums[b], n * n)) for b in range(d)] for a in range(d)]
    return kept, points, n, sums, np.array(v)


def sample(n, d, seed=2):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d))
    return [(i, [float(np.float32(c)) for c in mix @ rng.standard_normal(d)], i % 3) for i in range(n)]


def test_whitening_is_brute_force(spark):
    good = sample(200, 20)
    rows = good + [good[5]] * 70 + [(None, good[6][1], None), (900, good[7][1], 1)]
    bad = [(1, None, 1), (2, [1.0] * 19 + [None], 1), (3, [NAN] + [0.0] * 19, 1), (4, [INF] + [0.0] * 19, 1), (5, [-INF] * 20, None), (6, [1.0] * 7, 1), (7, [], 1)]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    kept, points, n, sums, v = brute_moments(rows)
    assert Counter(r["vec_id"] for r in got) == Counter({i: 16 * c for i, c in Counter(i for i, _ in kept).items()})
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, x in kept:
        y = [n * c - s for c, s in zip(x, sums)]
        for k in range(16):
            r = by[i, k + 1]
            assert r["n"] == n and r["deviation"] == sum(c * c for c in y) == int(r["deviation_digits"])
            want = float(np.dot([c / n for c in y], basis[:, k])) / values[k] ** 0.5
            sign = signs.setdefault(k, np.sign(want * r["whitened"]))
            assert abs(r["whitened"] * sign - want) < 1e-8
            assert abs(r["explained"] / (values[k] / np.trace(v)) - 1) < 1e-9 and 0 < r["identity_error"] < 1e-10


def test_whitening_has_as_many_components_as_rank(spark):
    rows = [(i, [float(i), 2.0 * i, 0.5, -1.0 * (i % 2)], 0) for i in range(8)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["component"]: r["whitened"] is None for r in got} == {1: False, 2: False, 3: True, 4: True}
    assert {r["identity_error"] < 1e-12 for r in got} == {True}
    one = whitening.whiten(vectors(spark, rows[:1])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    assert whitening.whiten(vectors(spark, [(1, None, 1), (2, [None], 1)])).collect() == []
    assert whitening.whiten(vectors(spark, rows).limit(0)).columns == ["vec_id", "component", "n", "deviation", "deviation_digits", "whitened", "explained", "identity_error"]


def test_whitening_keeps_small_variances_beside_huge_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [2.0**42 if i == 7 else float(rng.standard_normal()), *map(float, rng.standard_normal(5))], 0) for i in range(300)]
    got = whitening.whiten(vectors(spark, rows, "double")).collect()
    assert max(r["identity_error"] for r in got) < 1e-4 and all(r["whitened"] is not None for r in got)
    n = 300
    x = [[math.floor(c * 64) + 1_000_000 for c in v] for _, v, _ in rows]
    sums = [sum(col) for col in zip(*x)]
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation_digits"]) for r in got} == exact
    assert {r["vec_id"] for r in got if r["deviation"] is None} == {i for i, e in exact.items() if e >= 2**63} == set(range(300))


def test_exact_products_of_any_size():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 17, 1 << 18, 1 << 40, 1 << 58):
        x = rng.integers(-most, most, (57, 4))
        want = x.astype(object).T @ x.astype(object)
        assert (whitening.products(x) == want).all()
        assert (sum(limb.astype(object) * 2 ** (18 * i) for i, limb in enumerate(whitening.limbs(x))) == x).all() if most < 1 << 50 else True
    a = rng.integers(-9, 9, (6, 3)) @ rng.integers(-9, 9, (3, 6))
    assert whitening.rank(a.astype(object)) == 3
    values, basis = whitening.rotations((a @ a.T).astype(float))
    assert np.allclose(basis @ np.diag(values) @ basis.T, a @ a.T) and np.allclose(basis.T @ basis, np.eye(6))


# op13


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in x], label) for i, x, label in rows]
    width = len(kept[0][1]) // parts
    first = {}
    for i, x, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, x), x)
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    near = lambda x, p: min((far(cut(x, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, x, _ in kept:
            for p in range(parts):
                held[p][near(x, p)[1]].append(cut(x, p))
        books = [[[sum(c) // len(h) for c in zip(*h)] if h else e for e, h in zip(b, hs)] for b, hs in zip(books, held)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, x, label in kept:
        found = [near(x, p) for p in range(parts)]
        error = sum(e for e, _ in found)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return Counter((i, code, error, by_label[label], sha) for i, code, error, label in out)


@pytest.mark.parametrize("n", [150, 9, 1])
def test_codes_are_brute_force(spark, n):
    good = sample(n, 32, 7)
    rows = good + [good[0]] * 40 + [(None, good[-1][1], None), (0, good[n // 2][1], None), (5000, good[0][1], 2)]
    bad = [(1, None, 1), (2, [1.0] * 31 + [None], 1), (3, [NAN] * 32, 1), (4, [INF] + [0.0] * 31, 1), (-7, [1.0] * 16, 1), (-8, [], None)]
    got = vector_codes.compress(vectors(spark, rows + bad)).collect()
    assert Counter(map(tuple, got)) == brute_codes(rows)


def test_codes_of_blocks_and_labels_by_shuffle(spark, monkeypatch):
    rows = sample(300, 16, 9)
    want = brute_codes(rows)
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 1)
    assert Counter(map(tuple, vector_codes.compress(vectors(spark, rows)).collect())) == want


def test_codes_of_nothing_and_of_what_cannot_be_cut(spark):
    assert vector_codes.compress(vectors(spark, [(1, None, 1), (2, [NAN] * 16, 1)])).collect() == []
    assert [(r["code"], r["error"]) for r in vector_codes.compress(vectors(spark, [(None, [1.0] * 16, None)])).collect()] == [("00" * 16, 0)]
    for rows in ([(1, [1.0] * 15, 1)], [(1, [3e12] * 16, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(vectors(spark, rows))
