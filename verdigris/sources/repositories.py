"""Dataset files of repositories: found by their place, read by their extension, JSON or YAML.

Files are listed and read by Spark, so they may be in any store it reads. JSON is parsed in the JVM; YAML, which needs a
parser that may not be installed, is turned into JSON in Arrow batches first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.sources.files import DATASET

EXTENSIONS = ("json", "yaml", "yml")
#: Where repositories of each kind keep their datasets, below their base.
PLACES = {"native": ("datasets",), "generic": ("", "data", "datasets", "benchmarks")}
FILES = "path string, content binary"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(where)


def dataset_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(file, stem, extension, content) of the dataset files that lie in the folders themselves; a folder that is not
    there has none."""
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "file string, stem string, extension string, content string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(there)
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    stem, ending = F.regexp_extract(base, r"^(.*)\.[^.]*$", 1), F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    return found.select(F.col("path").alias("file"), stem.alias("stem"), ending.alias("extension"), F.decode("content", "UTF-8").alias("content"))


@F.pandas_udf(T.StringType())
def yaml_to_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What doesn't parse becomes null."""
    import yaml

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(yaml.safe_load(text), default=str) if text else None
        except yaml.YAMLError:
            return None

    for texts in batches:
        yield texts.map(one)


def parsed(files: DataFrame) -> DataFrame:
    """(file, stem, d, problem): the dataset in each file; ``problem`` says why there is none: it doesn't parse, or lacks a
    name or test cases, or has a case without id or prompt."""
    text = F.when(F.col("extension") == "json", F.col("content")).otherwise(yaml_to_json("content"))
    read = files.withColumn("json", text).withColumn("d", F.from_json("json", DATASET))
    broken = F.try_parse_json("json").isNull() | F.col("d").isNull()
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    cases = F.coalesce("d.test_cases", F.array().cast("array<struct<id: string, category: string, prompt: string, variables: map<string, string>, expected: string, references: array<string>>>"))
    problem = (
        F.when(broken, "does not parse").when(empty(F.col("d.name")), "no name").when(F.size(cases) == 0, "no test cases")
        .when(F.exists(cases, lambda c: empty(c["id"]) | empty(c["prompt"])), "a test case without id or prompt")
    )
    return read.select("file", "stem", "extension", "d", problem.alias("problem"))


def load_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(test cases of the datasets that are good, the files that are not and why): a bad file stops no other."""
    read = parsed(dataset_files(spark, folder))
    cases = read.where("problem IS NULL").select("file", "d.name", "d.version", F.explode("d.test_cases").alias("c")).select("file", "name", "version", "c.*")
    return cases, read.where("problem IS NOT NULL").select("file", "problem")


def discover(spark: SparkSession, kind: str, base: str) -> DataFrame:
    """(dataset, file): what a repository has. A native one's files are taken by their names; a generic one's only if
    there is a good dataset in them."""
    if kind.lower() not in PLACES:
        raise ValueError(f"unknown kind of repository: {kind}")
    files = dataset_files(spark, *[f"{base}/{p}".rstrip("/") for p in PLACES[kind.lower()]])
    found = files if kind.lower() == "native" else parsed(files).where("problem IS NULL")
    return found.select(F.col("stem").alias("dataset"), "file")


def load(spark: SparkSession, kind: str, base: str, dataset: str) -> DataFrame:
    """The test cases of one dataset; of files with that name the first by extension (json, yaml, yml), then by path. None,
    or a bad one, is an error."""
    if kind.lower() not in PLACES:
        raise ValueError(f"unknown kind of repository: {kind}")
    files = dataset_files(spark, *[f"{base}/{p}".rstrip("/") for p in PLACES[kind.lower()]]).where(F.col("stem") == dataset)
    order = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("extension"))
    first = parsed(files.orderBy(order, "file").limit(1))
    problem = first.select("problem").first()
    if problem is None or problem[0]:
        raise ValueError(f"dataset {dataset}: {'not found' if problem is None else problem[0]}")
    return first.select("d.name", "d.version", F.explode("d.test_cases").alias("c")).select("name", "version", "c.*")
