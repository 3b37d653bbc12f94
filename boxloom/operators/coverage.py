"""Label counts per class and split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.session import SPLITS


def _each_split(registry: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    return registry.select(
        "class_id", "name", F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))


def label_counts(labels: DataFrame) -> DataFrame:
    """Labels per split and class id. The only step that sees label rows: it combines map-side."""
    return labels.groupBy("split", "class_id").agg(F.count(F.lit(1)).alias("n"))


def coverage(registry: DataFrame, counts: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Counts of every registered class in every split, with zeros; unknown ids are ignored."""
    return (
        _each_split(registry, splits).join(counts, ["class_id", "split"], "left")
        .select("class_id", "name", "split", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def coverage_with_totals(cov: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """One row per class with a column per split and the total."""
    per_split = [
        F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).cast("bigint").alias(s)
        for s in splits
    ]
    return cov.groupBy("class_id", "name").agg(*per_split, F.sum("n").cast("bigint").alias("total"))


def coverage_long_with_totals(cov: DataFrame) -> DataFrame:
    """Long form with a ``total`` row per class, by rollup over the split."""
    return (
        cov.rollup("class_id", "name", "split").agg(F.sum("n").cast("bigint").alias("n"))
        .filter(F.grouping_id() <= 1)
        .select("class_id", "name", F.coalesce("split", F.lit("total")).alias("split"), "n")
    )


def missing_classes(cov: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Number of classes without labels, per split and overall."""
    wide = coverage_with_totals(cov, splits)
    names = [*splits, "total"]
    counts = wide.agg(*[F.count_if(F.col(s) == 0).cast("bigint").alias(s) for s in names])
    return counts.select(F.explode(F.create_map(
        *[c for s in names for c in (F.lit(s), F.col(s))])).alias("split", "missing"))


def split_stats(files: DataFrame, lines: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Files and label lines per split; files without lines count as files, lines of white space do not count."""
    seen = files.select("split", F.lit(1).alias("f"), F.lit(0).alias("l")).unionByName(
        lines.filter(F.btrim("line", F.lit(" \t\r\n\f\x0b")) != "").select("split", F.lit(0).alias("f"), F.lit(1).alias("l")))
    return (
        seen.filter(F.col("split").isin(list(splits))).groupBy("split")
        .agg(F.sum("f").cast("bigint").alias("files"), F.sum("l").cast("bigint").alias("labels"))
    )


def used_id_range(labels: DataFrame) -> DataFrame:
    """Distinct class ids with lowest and highest; nulls on empty input.

    Ids are made distinct first, so the final task sees one row per id.
    """
    ids = labels.select("class_id").distinct()
    return ids.agg(
        F.count("class_id").alias("n_ids"), F.min("class_id").alias("min_id"),
        F.max("class_id").alias("max_id"))


def images_per_split(images: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Images of every split, zero included. ``images`` holds one row per image."""
    zeros = images.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    counted = images.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return zeros.join(counted, "split", "left").select(
        "split", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def stored_coverage(registry: DataFrame, stored: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Stored counts (name, split, n as text) over zeros; unknown names and non-integers drop out."""
    whole = stored.select("name", "split", F.col("n").cast("string").try_cast("bigint").alias("n"))
    return (
        _each_split(registry, (*splits, "total")).join(whole, ["name", "split"], "left")
        .select("class_id", "name", "split", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )
