"""Every query of the engine's own operators, by name, and its SQL."""

from __future__ import annotations

from verdigris.plans import benchmarking, inference, more, records, streams, surfaces, texts, usage

MODULES = (benchmarking, inference, texts, records, more, usage, surfaces, streams)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
