"""What is shuffled for similarities of n-grams: texts, each of a small group once."""

from pyspark.sql import functions as F

from verdigris.operators import consistency


def test_texts_of_small_groups_are_sent_once(spark):
    outputs = spark.range(1000).select((F.col("id") % 200).alias("group_id"), F.col("id").alias("ordinal"), F.concat(F.lit("some text "), "id").alias("content"))
    blocks = consistency.blocks(outputs, outputs, "ordinal")
    assert tuple(blocks.agg(F.count("*"), F.sum(F.size("a")), F.count("b")).first()) == (200, 1000, 0)
    assert [f.name for f in blocks.schema["a"].dataType.elementType] == ["mark", "content"]
