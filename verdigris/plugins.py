"""Plugins: evaluators, transforms and filters that a user registers and names in a chain.

A transform is a function from a table to a table, a filter one from a table to the rows it keeps (its columns are the
table's), an evaluator one from (content, expected, option) to a column. They are DataFrame code, so they run where the rest of
a query does, and the optimizer sees through them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from verdigris.operators import verification

TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}
FILTERS: dict[str, Callable[..., DataFrame]] = {}


def register(kind: str, name: str, function: Callable) -> None:
    """A name is taken once: a second registration of another function is an error."""
    if kind == "evaluator":
        known = verification.SCORERS
    elif kind in ("transform", "filter"):
        known = TRANSFORMS if kind == "transform" else FILTERS
    else:
        raise ValueError(f"unknown kind of plugin: {kind}")
    if known.get(name, function) is not function:
        raise ValueError(f"{kind} {name} is registered already")
    known[name] = function


def apply(df: DataFrame, *chain: tuple) -> DataFrame:
    """The table after each link of the chain, (kind, name, options...). What isn't registered is an error, and so is a
    filter that changes the columns."""
    for kind, name, *options in chain:
        known = {"transform": TRANSFORMS, "filter": FILTERS}.get(kind)
        if known is None or name not in known:
            raise ValueError(f"no {kind} called {name}")
        out = known[name](df, *options)
        if kind == "filter" and out.columns != df.columns:
            raise ValueError(f"filter {name} changes the columns")
        df = out
    return df
