"""Vectors over a threshold against brute force, with what the bounds leave out."""

import numpy as np
import pytest

from verdigris.operators import search


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(2)


@pytest.mark.parametrize("least", [0.95, 0.3, 0.0, -0.5])
def test_search_is_brute_force(spark, least):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((12, 16))
    x = middles[rng.integers(0, 12, 900)] + 0.1 * rng.standard_normal((900, 16))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, [0.0] * 16), (1001, [1.0, 2.0]), (1002, None), (1003, []), (1004, rows[5][1]), (1005, [-c for c in rows[5][1]])]
    asked = [(i, v) for i, v in rows if i % 40 == 0 or i == 1001]
    counted = search.Products(spark)
    queries = spark.createDataFrame(asked, "query_id int, q array<float>")
    got = {(r["query_id"], r["vec_id"]): r["cosine"] for r in search.similar_vectors(table(spark, rows), queries, least, counted).collect()}
    want = {}
    for q, a in asked:
        for i, b in rows:
            if a and b and len(a) == len(b):
                norm = float(np.linalg.norm(a) * np.linalg.norm(b))
                c = round(float(np.dot(a, b)) / norm if norm else 0.0, 6)
                if c >= least:
                    want[q, i] = c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert counted.made.value + counted.skipped.value == sum(bool(b) and len(a) == len(b) for _, a in asked for _, b in rows)
    if least == 0.95:
        assert counted.share_skipped() > 0.7
