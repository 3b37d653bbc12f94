"""Training logs: metric tables and run settings, one folder per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.schemas import METRIC_COLUMNS, METRICS_CSV


def _run_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def column_name(raw: str) -> str:
    """Metric name without slashes and brackets: ``metrics/mAP50-95(B)`` is metrics_map50_95."""
    return raw.replace("(B)", "").replace("/", "_").replace("-", "_").lower()


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, epoch, time, …) of metric files such as runs/*/results.csv."""
    raw = spark.read.schema(METRICS_CSV).csv(
        pattern, header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True)
    return raw.select(
        _run_name(F.col("_metadata.file_path")).alias("run"),
        *[F.col(f"`{c}`").alias(column_name(c)) for c in METRIC_COLUMNS])


def setting_rows(lines: DataFrame) -> DataFrame:
    """(run, key, value) of flat ``key: value`` lines (run, line); ``null`` becomes NULL."""
    pattern = r"^([a-z0-9_]+): ?(.*)$"
    value = F.regexp_extract("line", pattern, 2)
    return lines.filter(F.col("line").rlike(pattern)).select(
        "run", F.regexp_extract("line", pattern, 1).alias("key"),
        F.when(value != "null", value).alias("value"))


def read_settings(spark: SparkSession, pattern: str) -> DataFrame:
    """Run settings such as runs/*/args.yaml as a long table."""
    lines = spark.read.text(pattern).select(
        _run_name(F.col("_metadata.file_path")).alias("run"), F.col("value").alias("line"))
    return setting_rows(lines)


def typed_settings(settings: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row per run with the named settings cast to their types."""
    return settings.groupBy("run").agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).try_cast(t).alias(k)
        for k, t in types.items()])
