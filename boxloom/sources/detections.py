"""Detection rows keyed by session and frame, as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxloom.schemas import DETECTION


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTION).parquet(path)


def stream_detections(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of detections in arrival order."""
    reader = spark.readStream.schema(DETECTION)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
