"""Discourse markers counted by class and in all, in few passes over a text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import coherence

TEXTS = [
    "However, such as well as such as a result; BUT butter, so-so. As well, as a result: in addition additionally.",
    "in in contrast on the other hand on the other handle so so so to sum up to summarize", "first second third thirds", "", "Yet.Yet_yet yet's étyet yet\nfor example for instance", None,
]


def singly(text, marks):
    return sum(len(re.findall(rf"\b{m}\b", text.lower())) for m in marks)


def test_markers_are_what_they_are_one_by_one(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for r in df.select("id", "text", X.marker_count(F.col("text")).alias("all"), *[c.alias(k) for k, c in X.marker_counts(F.col("text")).items()]).collect():
        want = {k: None if r["text"] is None else singly(r["text"], m) for k, m in X.MARKERS.items()}
        assert {k: r[k] for k in X.MARKERS} == want
        assert r["all"] == (None if r["text"] is None else sum(want.values()))


def test_no_marker_begins_as_another_one():
    found = [m for marks in X.MARKERS.values() for m in marks]
    assert not [(a, b) for a in found for b in found if a != b and re.match(rf"{a}\b", b)] and len(set(found)) == len(found)


def test_few_passes_over_a_text(spark):
    df = spark.createDataFrame([(1, "so")], "id int, text string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(df.select(*X.marker_counts(F.col("text")).values())).count("regexp_extract_all") == len(X.MARKERS)
    assert plan(coherence.violations(df).select("markers")).count("regexp_extract_all") == 1
