"""An event bus of files: streams publish to topics, subscribers read them as streams, whatever store they are in.

A micro-batch becomes one folder, named by its number. It is written beside the bus and moved into it whole, so subscribers see all of a
batch or nothing; a batch that is there already is not published again. Subscribers have their offsets in their checkpoint. So a publisher or
a subscriber that stops, or fails in the middle of a batch, goes on where it was: nothing is lost and nothing comes twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from verdigris.streaming.monitoring import subscribed


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.sc().hadoopConfiguration())


def post(batch: DataFrame, number: int, bus: str) -> bool:
    """A batch of messages (topic ...) as the bus's folder of this number; False if it is there."""
    spark = batch.sparkSession
    path, files = spark._jvm.org.apache.hadoop.fs.Path, file_system(spark, bus)
    final = path(f"{bus}/batch={int(number)}")
    if files.exists(final):
        return False
    beside = f"{bus}/_making/{int(number)}-{uuid.uuid4().hex}"
    batch.write.partitionBy("topic").parquet(beside)
    files.delete(path(f"{beside}/_SUCCESS"), False)
    if not files.rename(path(beside), final):
        raise OSError(f"batch {number} could not be moved into the bus")
    return True


def publish(messages: DataFrame, bus: str, checkpoint: str, wait: bool = True):
    """Publishes what a stream of messages has now, batch by batch, and stops. ``topic`` says where a message goes; those
    without one go nowhere."""

    def handle(batch: DataFrame, number: int) -> None:
        post(batch, number, bus)

    query = messages.where("topic IS NOT NULL").writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


def subscribe(spark: SparkSession, bus: str, schema: str, topics: list[str], batches: int = 1) -> DataFrame:
    """The messages (``schema``, and topic) of the chosen topics as a stream; ``batches`` is how many files a trigger takes."""
    named = f"{schema}, topic string, batch long"
    stream = spark.readStream.schema(named).option("basePath", bus).option("maxFilesPerTrigger", batches).parquet(f"{bus}/batch=*/topic=*")
    return subscribed(stream, topics).drop("batch")
