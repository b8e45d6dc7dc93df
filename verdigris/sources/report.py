"""Executive report of a fleet: one HTML page from aggregated rows.

Every section has the number of its rows in its title and lists all of them. The page's lines are made
and put in order by executors, so a report of many repositories needs no room on the driver unless it is
asked for as one string.
"""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.storage import stored
from verdigris.operators import benchmark

FAILING_BELOW = 0.9
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}
HEAD = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Fleet report</title></head><body>"


def shown(df: DataFrame, name: str) -> Column:
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        text = F.format_number(c, 0)
    elif kind in ("float", "double"):
        text = F.format_number(c, 4)
    else:
        text = reduce(lambda t, e: F.replace(t, F.lit(e), F.lit(ESCAPES[e])), ESCAPES, c.cast("string"))
    return F.coalesce(text, F.lit("None"))


def section(number: int, title: str, df: DataFrame, rate: str | None = None, name: str | None = None) -> DataFrame:
    """(section, part, rate, name, line): the lines of a table of all rows of ``df``, by ``rate`` and then ``name``."""
    key = lambda c, kind: F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    head = "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>"
    place = lambda part, r, n: (F.lit(number).alias("section"), F.lit(part).alias("part"), r.alias("rate"), n.alias("name"))
    rows = df.select(*place(1, key(rate, "double"), key(name, "string")), F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), shown(df, c), F.lit("</td>")) for c in df.columns], F.lit("</tr>")).alias("line"))
    found = df.agg(F.format_number(F.count("*"), 0).alias("found"))
    ends = found.select(
        F.inline(
            F.array(
                F.struct(*place(0, key(None, "double"), key(None, "string")), F.concat(F.lit(f"<h2>{html.escape(title)} ("), "found", F.lit(f" found)</h2>{head}")).alias("line")),
                F.struct(*place(2, key(None, "double"), key(None, "string")), F.lit("</table>").alias("line")),
            )
        )
    )
    return ends.unionByName(rows)


def report_lines(results: DataFrame, failing_below: float = FAILING_BELOW) -> DataFrame:
    """(line): the sections' lines, in the order of the page. The results are made once for all of them."""
    results = stored(results.select(*benchmark.SUMMED))
    parts = [
        section(0, "Fleet", benchmark.fleet_summary(results)),
        section(1, "Providers", benchmark.breakdown(results, "provider"), name="provider"),
        section(2, "Categories", benchmark.breakdown(results, "category"), name="category"),
        section(3, "Best and worst", benchmark.best_and_worst(results), name="kind"),
        section(4, f"Failing repositories, below {failing_below:.0%}", benchmark.failing(results, failing_below), "success_rate", "repository"),
    ]
    edges = results.sparkSession.createDataFrame([(-1, HEAD), (len(parts), "</body></html>")], "section int, line string")
    lines = reduce(lambda a, b: a.unionByName(b), parts).unionByName(edges, allowMissingColumns=True)
    return lines.orderBy("section", "part", "rate", "name", "line").select("line")


def executive_report(results: DataFrame, failing_below: float = FAILING_BELOW) -> str:
    return "".join(r["line"] for r in report_lines(results, failing_below).collect())


def write_report(results: DataFrame, path: str) -> None:
    """The report as text files in the folder ``path``, which all executors share; in the order of their
    names they are the page."""
    report_lines(results).write.mode("overwrite").text(path)
