"""Edit distances of many texts at a time."""

from __future__ import annotations

import random

import numpy as np
import pytest

from verdigris.functions import edits as M
from verdigris.operators import consistency
from verdigris.plans import texts


@pytest.mark.parametrize("bits", [8, 30, 1 << 14])
def test_a_table_of_edits_is_that_of_single_pairs(monkeypatch, bits):
    monkeypatch.setattr(M, "BITS", bits)
    draw = random.Random(bits)
    for _ in range(60):
        held = ["".join(draw.choice("ab\0é😀") for _ in range(draw.choice([0, 1, 3, 9, 40]))) for _ in range(draw.randint(0, 9))]
        assert M.edit_table(held).tolist() == [[M.edits(a, b) for b in held] for a in held]


def test_likeness_of_null_and_empty_texts():
    found = consistency.edit_likeness(["abc", None, "", "", "abd"])
    assert np.isnan(found[1]).all() and np.isnan(found[:, 1]).all()
    assert found[2, 3] == 1 and found[0, 2] == 0 and found[0, 4] == 1 - 1 / 3


def test_sim2_compares_a_large_group_block_by_block(spark, tmp_path):
    said = [f"turn {k % 7} of {k % 13} " * (k % 3) for k in range(110)]
    rows = [(1, k, "user", None if k == 50 else t) for k, t in enumerate(said)] + [(2, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = texts.sim2(spark, str(tmp_path))
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    found = {(r["i"], r["j"]): r["similarity"] for r in df.collect()}
    assert len(found) == 110 * 109 // 2
    for (i, j), alike in found.items():
        a, b = said[i], said[j]
        assert i < j and (alike is None if 50 in (i, j) else alike == pytest.approx(1 - M.edits(a, b) / max(len(a), len(b)) if a or b else 1.0, abs=1e-6))
