"""Keyed writes to a database: staged by the executors, merged in one transaction.

Executors append their rows to a staging table, under the number of the run. A task that is tried again may stage its
rows once more; a run that failed may leave some behind. Neither matters: the merge takes one row a key, and a run's
rows are cleared before they are staged. The merge is one transaction, which also notes the run's number, so a run that is
repeated after it was merged changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def transaction(spark: SparkSession, url: str, driver: str) -> Iterator:
    """A statement on a connection of the driver's; committed at the end, or rolled back by an error."""
    spark._jvm.java.lang.Class.forName(driver)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        yield statement
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def exists(statement, table: str) -> bool:
    found = statement.getConnection().getMetaData().getTables(None, None, table.upper(), None)
    return found.next()


def stage(rows: DataFrame, run: int, url: str, table: str, driver: str, keys: list[str], column_types: dict[str, str]) -> None:
    """The executors' part: rows under the number of their run. Only keys have their types here, as they are compared; what
    else is staged is cast by the merge."""
    spark, name = rows.sparkSession, f"{table}_stage"
    with transaction(spark, url, driver) as t:
        if exists(t, name):
            t.executeUpdate(f'DELETE FROM {name} WHERE "_run" = {int(run)}')
    numbered = rows.withColumn("_run", F.lit(int(run)).cast("long"))
    append(numbered, url, name, driver, {k: column_types[k] for k in keys if k in column_types})
    with transaction(spark, url, driver) as t:
        found = t.getConnection().getMetaData().getIndexInfo(None, None, name.upper(), False, False)
        if not found.next():
            t.executeUpdate(f'CREATE INDEX {name}_keys ON {name} ("_run", {", ".join(map(quoted, keys))})')


def append(rows: DataFrame, url: str, table: str, driver: str, types: dict[str, str]) -> None:
    options = {"createTableColumnTypes": ", ".join(f"{c} {kind}" for c, kind in types.items())} if types else {}
    rows.write.format("jdbc").options(url=url, dbtable=table, driver=driver, **options).mode("append").save()


def quoted(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def merge(spark: SparkSession, run: int, url: str, table: str, driver: str, keys: list[str], columns: list[str], column_types: dict[str, str]) -> bool:
    """The run's staged rows into the table: a null keeps the value there is, as a partial update does. False if the run was
    merged before."""
    staged, runs, mine = f"{table}_stage", f"{table}_runs", f's."_run" = {int(run)}'
    same = " AND ".join(f"s.{quoted(k)} = {table}.{quoted(k)}" for k in keys)
    values = [c for c in columns if c not in keys]
    largest = lambda c: f"MAX(CAST(s.{quoted(c)} AS {column_types[c]}))" if c in column_types else f"MAX(s.{quoted(c)})"
    with transaction(spark, url, driver) as t:
        if not exists(t, runs):
            t.executeUpdate(f'CREATE TABLE {runs} ("run" BIGINT NOT NULL PRIMARY KEY)')
        before = t.executeQuery(f'SELECT count(*) FROM {runs} WHERE "run" = {int(run)}')
        before.next()
        if before.getLong(1):
            return False
        if values:
            sets = ", ".join(f"{quoted(c)} = COALESCE((SELECT {largest(c)} FROM {staged} s WHERE {mine} AND {same}), {quoted(c)})" for c in values)
            t.executeUpdate(f"UPDATE {table} SET {sets} WHERE EXISTS (SELECT 1 FROM {staged} s WHERE {mine} AND {same})")
        named = ", ".join(map(quoted, [*keys, *values]))
        picked = ", ".join([*[f"s.{quoted(k)}" for k in keys], *map(largest, values)])
        t.executeUpdate(
            f"INSERT INTO {table} ({named}) SELECT {picked} FROM {staged} s WHERE {mine} AND NOT EXISTS (SELECT 1 FROM {table} WHERE {same}) GROUP BY {', '.join(f's.{quoted(k)}' for k in keys)}"
        )
        t.executeUpdate(f'INSERT INTO {runs} VALUES ({int(run)})')
        t.executeUpdate(f"DELETE FROM {staged} s WHERE {mine}")
    return True


def upsert(rows: DataFrame, keys: list[str], run: int, url: str, table: str, driver: str, column_types: dict[str, str] | None = None) -> bool:
    """Inserts ``rows``, or updates those whose keys are there already; of rows with equal keys each column's
    largest value counts. ``column_types`` says what texts are to the
    database (``{"name": "VARCHAR(100)"}``), as they have to be comparable. Rows with a null key are left out. False if the run was merged before."""
    spark, rows, column_types = rows.sparkSession, rows.dropna(subset=keys), column_types or {}
    with transaction(spark, url, driver) as t:
        made = exists(t, table)
    if not made:
        append(rows.limit(0), url, table, driver, column_types)
        with transaction(spark, url, driver) as t:
            t.executeUpdate(f"CREATE INDEX {table}_keys ON {table} ({', '.join(map(quoted, keys))})")
    stage(rows, run, url, table, driver, keys, column_types)
    return merge(spark, run, url, table, driver, keys, rows.columns, column_types)
