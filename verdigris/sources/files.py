"""Sources and sinks: datasets, result files, manifests, exports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of datasets and results, and the columns of the result CSV.
DATASET = """name STRING, description STRING, version STRING,
test_cases ARRAY<STRUCT<id: STRING, category: STRING, prompt: STRING, variables: MAP<STRING, STRING>, expected: STRING, references: ARRAY<STRING>>>"""
RESULT = """test_id STRING, category STRING, status STRING,
response STRUCT<id: STRING, model: STRING, content: STRING, usage: STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT>, finish_reason: STRING>,
error STRING, duration_ms BIGINT, timestamp TIMESTAMP"""
EXPORT = ("test_id", "category", "status", "duration_ms", "tokens", "cost", "model", "prompt_length", "response_length", "prompt_tokens", "completion_tokens", "finish_reason", "error", "timestamp")


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """Dataset files (JSON, one dataset each); a file that doesn't parse is left out, and its name is
    in ``bad_datasets``."""
    raw = spark.read.schema(DATASET + ", _corrupt_record STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.withColumn("file", F.col("_metadata.file_path"))


def test_cases(found: DataFrame) -> DataFrame:
    """One row per test case of the valid datasets: name, id and prompt must not be empty."""
    good = found.where("_corrupt_record IS NULL AND name != '' AND size(test_cases) > 0")
    return good.select("name", "version", F.explode("test_cases").alias("c")).select("name", "version", "c.*").where("id != '' AND prompt != ''")


def bad_datasets(found: DataFrame) -> DataFrame:
    return found.where("_corrupt_record IS NOT NULL OR name IS NULL OR name = '' OR coalesce(size(test_cases), 0) < 1").select("file")


def results_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Results, one JSON object a line; blank and malformed lines are dropped."""
    return spark.read.schema(RESULT).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def benchmark_json(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): whole benchmarks, one pretty-printed object each, results in order of test_id. A benchmark is what one
    run of a dataset made, so it fits a row."""
    inner = [c for c in results.columns if c not in keys]
    whole = results.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*sorted(inner, key=lambda c: c != "test_id")))).alias("results"))
    return whole.select(*keys, F.to_json(F.struct(*keys, F.size("results").alias("total_tests"), "results"), {"pretty": "true"}).alias("json"))


def save_json(results: DataFrame, keys: list[str], path: str) -> None:
    """One file for each benchmark."""
    benchmark_json(results, keys).repartition(*keys).select("json").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def load_json(spark: SparkSession, path: str, header: str, result: str) -> DataFrame:
    """The results of whole-benchmark files, under their benchmarks' fields."""
    names = [f.split()[0] for f in header.split(",")]
    read = spark.read.schema(f"{header}, results ARRAY<STRUCT<{result}>>").option("multiLine", True).json(path)
    return read.select(*names, F.explode("results").alias("r")).select(*names, "r.*")


#: The columns of the runner agent's CSV, and the heads of its table.
AGENT_CSV = ("test_id", "iteration", "provider_name", "model_id", "success", "latency_ms", "prompt_tokens", "completion_tokens", "cost_usd")
AGENT_TABLE = ("| Provider | Model | Success Rate | P50 (ms) | P95 (ms) | Mean (ms) | Total Cost |", "|----------|-------|--------------|----------|----------|-----------|------------|")


def formatted(df: DataFrame, how: str, *order: str) -> DataFrame:
    """(place, line): a command's output in one of its formats. ``csv`` expects the columns of AGENT_CSV; ``table``
    provider, model, success_rate, p50, p95, mean and total_cost, and says so if there are none; ``jsonl`` has a line a row."""
    if how == "csv":
        line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in AGENT_CSV])
        heads: tuple[str, ...] = (",".join(AGENT_CSV),)
    elif how == "table":
        pad = lambda c, n: F.rpad(c, n, " ")
        wide = F.when(F.char_length("provider") >= 8, F.col("provider")).otherwise(pad("provider", 8))
        numbers = F.format_string("%11.1f%% | %8.0f | %8.0f | %9.0f | $%9.4f |", F.col("success_rate") * 100, *[F.col(c).cast("double") for c in ("p50", "p95", "mean", "total_cost")])
        line, heads = F.concat(F.lit("| "), wide, F.lit(" | "), pad(F.substring("model", 1, 5), 5), F.lit(" | "), numbers), AGENT_TABLE
    elif how in ("json", "jsonl"):
        line, heads = F.to_json(F.struct(*df.columns), {"pretty": "true"} if how == "json" else {}), ()
    else:
        raise ValueError(f"unknown format: {how}")
    rows = df.select(*order, line.alias("line"))
    lines = rows.select(F.struct(F.lit(1).alias("part"), F.struct(*order).alias("by")).alias("place") if order else F.lit(None).alias("place"), "line").select(F.to_json("place").alias("place"), "line")
    first = df.sparkSession.createDataFrame([(f"{k}", h) for k, h in enumerate(heads)], "place string, line string")
    return first.unionByName(lines) if heads else lines


def persist_decisions(decisions: DataFrame, path: str) -> None:
    """Appends decision or telemetry events, by agent. A retry may append the same ones again: ``decisions`` reads each once."""
    decisions.write.mode("append").partitionBy("agent_id").parquet(path)


def decisions(spark: SparkSession, path: str, agent: str | None = None) -> DataFrame:
    """Persisted events, each once by its id; of one agent only that agent's files are read."""
    found = spark.read.parquet(path)
    return (found if agent is None else found.where(F.col("agent_id") == agent)).dropDuplicates(["id"])


def decision(spark: SparkSession, path: str, key) -> DataFrame:
    """The persisted event of an id, once; no row if there is none."""
    return spark.read.parquet(path).where(F.col("id") == key).limit(1)


def export_view(results: DataFrame) -> DataFrame:
    """The 14 columns of the result CSV as text; nulls are empty, cost has six decimals. The prompt's
    length is that of the prompt."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    col = lambda n: F.col(n) if n in results.columns else F.lit(None)
    special = {"cost": F.coalesce(F.format_string("%.6f", col("cost").cast("double")), F.lit(""))}
    special["cost"] = F.when(col("cost").isNull(), "").otherwise(special["cost"])
    return results.select(*[special.get(n, text(col(n))).alias(n) for n in EXPORT])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("delimiter", delimiter).option("emptyValue", "").csv(path)


def manifest(source: str) -> dict:
    """A fleet manifest, JSON or (where a YAML parser is installed) YAML; checked."""
    text = Path(source).read_text(encoding="utf-8")
    if source.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    for name in ("fleet_id", "repositories", "providers", "scenario_profiles"):
        if not found.get(name):
            raise ValueError(f"manifest lacks {name}")
    unknown = {s for r in found["repositories"] for s in r.get("scenarios", [])} - set(found["scenario_profiles"])
    if unknown:
        raise ValueError(f"unknown scenarios: {sorted(unknown)}")
    return found


def fleet_plan(spark: SparkSession, found: dict) -> DataFrame:
    """(repo_id, scenario, provider, model): what a manifest asks to be run."""
    repos = spark.createDataFrame([(r["repo_id"], r.get("scenarios", [])) for r in found["repositories"]], "repo_id string, scenarios array<string>")
    providers = spark.createDataFrame([(p,) for p in found["providers"]], "spec string")
    part = F.split("spec", ":", 2)
    plan = repos.select("repo_id", F.explode("scenarios").alias("scenario")).crossJoin(F.broadcast(providers))
    return plan.select("repo_id", "scenario", part[0].alias("provider"), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("")).alias("model"))


def jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A database table; filters and columns are pushed down by the source."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    """Inserts rows, in batches from each task; ``overwrite`` with ``truncate`` keeps the table's definition."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def yaml_lines(df: DataFrame) -> DataFrame:
    """(line): a list item for each row with its columns in order. Texts are quoted as JSON does, which YAML reads."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    fields = [F.concat(F.lit(f"{'- ' if k == 0 else '  '}{c}: "), F.coalesce(quoted(F.col(c)), F.lit("null"))) for k, c in enumerate(df.columns)]
    return df.select(F.concat_ws("\n", *fields).alias("line"))


def fan_out(views: dict[str, DataFrame], base: str, formats: list[str]) -> list[str]:
    """Writes a fleet's views (summary, repositories, providers, categories ...) in each of the formats, json, yaml and csv,
    below ``base``; returns the folders written. Any other format is an error, before anything is written."""
    if unknown := set(formats) - {"json", "yaml", "csv"}:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    written = []
    for name, df in views.items():
        df = df.persist() if len(formats) > 1 else df  # made once for all formats
        for how in formats:
            at = f"{base}/{how}/{name}"
            if how == "csv":
                write_csv(df, at)
            elif how == "json":
                df.write.mode("overwrite").json(at)
            else:
                yaml_lines(df).write.mode("overwrite").text(at)
            written.append(at)
        df.unpersist()
    return written


def ordered_json(df: DataFrame, *order: str) -> DataFrame:
    """One JSON object a row, keys in order, rows to be written in order."""
    return df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))
