"""What is made of the same rows several times makes those rows once."""

from __future__ import annotations

import pytest

from verdigris.operators import benchmark, stress
from verdigris.plans import surfaces
from verdigris.sources import report


def counted(df):
    """``df``, and how many of its rows have been made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(each, df.schema), made


def fleet(spark):
    rows = [(p, c, r, "success" if (r + k) % 3 else "failure", 10 * r + k, 5, 6) for p in "ab" for c in "xy" for r in range(5) for k in range(4)]
    return spark.createDataFrame(rows, "provider string, category string, repository long, status string, duration_ms long, prompt_tokens long, completion_tokens long")


def test_report_makes_results_once(spark):
    results, made = counted(fleet(spark))
    lines = [r["line"] for r in report.report_lines(results).collect()]
    assert made.value == 80
    assert sum("<td>" in x for x in lines) == 1 + 2 + 2 + 2 + benchmark.failing(fleet(spark), 0.9).count()


def test_fan_out_makes_results_once(spark, monkeypatch):
    results, made = counted(fleet(spark))
    monkeypatch.setattr(surfaces, "results", lambda *_: results)
    found = {(r["format"], r["view"]): r["lines"] for r in surfaces.snk7(spark, "").collect()}
    assert made.value == 80
    assert found["csv", "repositories"] == found["json", "repositories"] == 5 and found["csv", "summary"] == 1


REQUESTS = "scenario string, provider string, model string, level int, success boolean, failure_mode string, ts timestamp_ntz, tie string"


def requests(spark):
    """Times repeat, so ties decide; one scenario never fails, one never recovers, one has no time at all for its first."""
    at = lambda d: f"TIMESTAMP_NTZ'2024-01-0{d} 00:00:00'"
    rows = []
    for k in range(40):
        rows.append(("mixed", 1 + k % 4, "true" if k * 7 % 5 > 1 else "false", at(1 + k % 3), f"t{k * 11 % 40:02}"))
    rows += [("held", 1, "true", at(d), f"h{d}") for d in (1, 2)]
    rows += [("lost", 1, "true" if d == 1 else "false", at(d), f"l{d}") for d in (1, 2, 3)]
    rows += [("timeless", 1, "false", "NULL", "n"), ("timeless", 1, "true", at(2), "n"), ("timeless", 1, "false", at(2), "o")]
    values = ", ".join(f"('{s}', 'p', 'm', {level}, {ok}, 'x', {ts}, '{tie}')" for s, level, ok, ts, tie in rows)
    return spark.sql(f"SELECT scenario, provider, model, level, success, failure_mode, CAST(ts AS TIMESTAMP_NTZ) AS ts, tie FROM VALUES {values} t(scenario, provider, model, level, success, failure_mode, ts, tie)")


def recovered(rows):
    """(ms, rate) by walking through a scenario's requests in order."""
    placed = sorted(rows, key=lambda r: (r["ts"] is not None, r["ts"], r["tie"]) if r["ts"] else (False, None, r["tie"]))
    failed = next((k for k, r in enumerate(placed) if not r["success"]), None)
    back = None if failed is None else next((k for k in range(failed + 1, len(placed)) if placed[k]["success"]), None)
    if back is None:
        return None, 1.0
    a, b = placed[failed]["ts"], placed[back]["ts"]
    return (None if a is None else int((b - a).total_seconds() * 1000)), sum(r["success"] for r in placed[back:]) / (len(placed) - back)


@pytest.mark.parametrize("most", [10_000, 1])
def test_recovery_makes_requests_once(spark, monkeypatch, most):
    monkeypatch.setattr(stress, "MOST_SCENARIOS", most)
    rows, made = counted(requests(spark))
    found = {r["scenario"]: (r["recovery_ms"], r["stability"]) for r in stress.recovery(rows).collect()}
    assert made.value == 48
    held = requests(spark).collect()
    for scenario in ("mixed", "held", "lost", "timeless"):
        ms, rate = recovered([r for r in held if r["scenario"] == scenario])
        assert found[scenario] == (ms, round(rate, 6))


def test_robustness_makes_requests_once(spark):
    rows, made = counted(requests(spark))
    (one,) = stress.robustness(rows).collect()
    assert made.value == 48 and one["common_failure"] == "x"
