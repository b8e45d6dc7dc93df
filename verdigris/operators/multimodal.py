"""Messages of several media, examples of multi-modal tasks, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of media; tasks of examples.
MEDIA = ("text", "image", "audio", "video")
TASKS = (
    "image_captioning", "visual_question_answering", "image_classification", "object_detection", "ocr", "speech_to_text", "text_to_speech", "audio_classification", "video_understanding",
    "image_generation", "audio_generation",
)
PART = "struct<kind: string, content: string>"
EXAMPLE = f"id string, task string, input struct<parts: array<{PART}>>, expected_output string, metadata string"


def media_type_counts(parts: Column) -> list[Column]:
    """How many of a message's parts (kind, content) are of each kind of medium."""
    of = lambda kind: F.size(F.filter(parts, lambda p: p["kind"] == kind)).alias(kind)
    return [of(kind) for kind in MEDIA]


def of_task(examples: DataFrame, task: str) -> DataFrame:
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}")
    return examples.where(F.col("task") == task)


def task_distribution(examples: DataFrame) -> DataFrame:
    return examples.groupBy("task").agg(F.count("*").alias("n"))


def score(vision: Column, word_errors: Column) -> Column:
    """The mean of the branches that are there: the vision score, and one less the word error rate, 0 at least; 0 without any."""
    some = F.filter(F.array(vision, F.when(word_errors.isNotNull(), F.greatest(F.lit(0.0), 1 - word_errors))), lambda x: x.isNotNull())
    return F.when(vision.isNull() & word_errors.isNull(), 0.0).otherwise(F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))
