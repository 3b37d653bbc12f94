"""Class lists and stored coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.operators.registry import clean_class_list
from boxloom.schemas import CLASS_LIST, COVERAGE, REGISTRY


def class_entries(lists: DataFrame, on_missing: str = "raise") -> DataFrame:
    """(pos, raw_name) of a one-row class list; an absent list raises or counts as empty."""
    names = F.col("names")
    if on_missing == "raise":
        names = F.when(names.isNotNull(), names).otherwise(
            F.raise_error(F.lit("class list has no names")).cast("array<string>"))
    elif on_missing != "empty":
        raise ValueError(f"unknown on_missing {on_missing}")
    return lists.select(F.posexplode(names).alias("pos", "raw_name"))


def read_class_list(spark: SparkSession, path: str, on_missing: str = "raise") -> DataFrame:
    """Registry from a JSON file with a ``names`` array, cleaned and numbered."""
    lists = spark.read.schema(CLASS_LIST).option("multiLine", True).json(path)
    return clean_class_list(class_entries(lists, on_missing))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(path)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COVERAGE).parquet(path)
