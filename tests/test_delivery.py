"""Keyed database writes and the event bus, with failures in the middle."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.sources import database, files
from verdigris.plans import surfaces
from verdigris.sources import snapshots
from types import SimpleNamespace
from verdigris.streaming import monitoring, topics

TYPES = {"name": "VARCHAR(100)", "status": "VARCHAR(20)"}
SCHEMA = "id long, name string, status string, score double"


@pytest.fixture
def at():
    return {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def stored(spark, at):
    return {r["id"]: (r["name"], r["status"], r["score"]) for r in files.jdbc(spark, table="RUNS_OF", **at).collect()}


def put(spark, rows, run, at):
    return database.upsert(spark.createDataFrame(rows, SCHEMA).repartition(3), ["id"], run, table="RUNS_OF", column_types=TYPES, **at)


def test_rows_are_inserted_or_updated(spark, at):
    assert put(spark, [(i, f"n{i}", "pending", None) for i in range(20)] + [(None, "x", "y", 1.0)], 1, at)
    assert put(spark, [(3, None, "completed", 0.5), (25, "new", None, 1.5), (25, "new", None, 1.5)], 2, at)
    want = {i: (f"n{i}", "pending", None) for i in range(20)} | {3: ("n3", "completed", 0.5), 25: ("new", None, 1.5)}
    assert stored(spark, at) == want
    assert not put(spark, [(3, "late", "late", 9.0), (99, "late", None, None)], 2, at)
    assert stored(spark, at) == want


def test_a_run_that_fails_in_mid_write_is_repeated_whole(spark, at):
    """Some tasks have staged their rows when another fails; one of them has staged them twice."""
    rows = [(i, f"n{i}", "pending", float(i)) for i in range(90)]
    put(spark, rows[:5], 1, at)
    df = spark.createDataFrame(rows, SCHEMA).repartitionByRange(3, "id")
    bad = df.withColumn("score", F.when(F.col("id") == 80, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        database.upsert(bad, ["id"], 2, table="RUNS_OF", column_types=TYPES, **at)
    assert len(stored(spark, at)) == 5
    left = files.jdbc(spark, table="RUNS_OF_stage", **at).where("`_run` = 2").count()
    assert 0 < left < 90
    database.stage(df, 2, table="RUNS_OF", keys=["id"], column_types=TYPES, **at)
    files.write_jdbc(df.where("id < 30").withColumn("_run", F.lit(2).cast("long")), table="RUNS_OF_stage", **at)
    assert files.jdbc(spark, table="RUNS_OF_stage", **at).count() == 120
    assert database.merge(spark, 2, table="RUNS_OF", keys=["id"], columns=df.columns, column_types=TYPES, **at)
    assert stored(spark, at) == {r[0]: r[1:] for r in rows}
    assert files.jdbc(spark, table="RUNS_OF", **at).count() == 90 and files.jdbc(spark, table="RUNS_OF_stage", **at).count() == 0


def messages(n, start=0):
    names = [*monitoring.TOPICS, None]
    return [(i, f"m{i}", names[i % len(names)]) for i in range(start, start + n)]


def test_the_bus_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    schema, bus = "id long, body string, topic string", str(tmp_path / "bus")
    chosen = ["request.logs", "system.metrics"]

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def published():
        source = monitoring.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
        topics.publish(source, bus, str(tmp_path / "publisher"))

    def received():
        stream = topics.subscribe(spark, bus, "id long, body string", chosen)
        monitoring.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "subscriber")).awaitTermination()
        return Counter(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive(messages(40))
    published()
    want = lambda n: Counter(i for i, _, t in messages(n) if t in chosen)
    assert received() == want(40)
    arrive(messages(30, 40))
    real = topics.post

    def half(batch, number, at):
        """The batch is published, but the publisher dies before it can note so."""
        real(batch, number, at)
        raise RuntimeError("killed")

    monkeypatch.setattr(topics, "post", half)
    with pytest.raises(Exception, match="killed"):
        published()
    monkeypatch.setattr(topics, "post", real)
    assert received() == want(70)
    published()
    arrive(messages(10, 70))
    published()
    assert received() == want(80)
    with pytest.raises(ValueError):
        topics.subscribe(spark, bus, "id long", ["gossip"])


def test_runs_are_merged_into_a_table_of_files(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "runs")
    runs = lambda rows, run: snapshots.upsert(spark.createDataFrame(rows, SCHEMA).repartition(3), ["id"], run, at)
    there = lambda: {r["id"]: (r["name"], r["status"], r["score"]) for r in snapshots.read(spark, at).collect()}
    assert runs([(i, f"n{i}", "pending", None) for i in range(20)] + [(None, "x", "y", 1.0)], 1)
    assert runs([(3, None, "completed", 0.5), (25, "new", None, 1.5), (25, "newer", None, 1.0)], 2)
    want = {i: (f"n{i}", "pending", None) for i in range(20)} | {3: ("n3", "completed", 0.5), 25: ("newer", None, 1.5)}
    assert there() == want and snapshots.read(spark, at).count() == 21
    assert not runs([(3, "late", "late", 9.0)], 2) and there() == want
    bad = spark.createDataFrame([(1, "n", "s", 1.0)], SCHEMA).withColumn("score", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        snapshots.upsert(bad, ["id"], 3, at)
    assert there() == want and runs([(1, None, None, 7.0)], 3) and there() == want | {1: ("n1", "pending", 7.0)}


def test_upserts_need_no_database_where_executors_have_their_own_jvm(spark, monkeypatch):
    monkeypatch.setattr(surfaces, "database", lambda spark: None)
    found = {r["id"]: r["name"] for r in surfaces.Q["SNK8_jdbc_upsert"](spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == 15 and all((found[i] == "changed") == (i % 5 == 0) for i in range(10, 25))


def test_which_masters_have_an_embedded_database():
    reached = lambda master: surfaces.database(SimpleNamespace(sparkContext=SimpleNamespace(master=master))) is not None
    assert [reached(m) for m in ("local", "local[4]", "local-cluster[3,2,3000]", "spark://host:7077", "yarn")] == [True, True, False, False, False]
