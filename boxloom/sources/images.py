"""Image inventories: paths only, pixels are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The extension lists of the different callers.
CARD_IMAGES = ("png",)
DATASET_IMAGES = ("png", "jpg", "jpeg")
TEMPLATE_IMAGES = ("png", "jpg")
SLOT_IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")


def with_extension(paths: DataFrame, extensions: tuple[str, ...] = DATASET_IMAGES) -> DataFrame:
    """Rows of (path) with a wanted extension in any case."""
    wanted = r"\.(" + "|".join(extensions) + r")$"
    return paths.filter(F.lower("path").rlike(wanted))


def path_parts(paths: DataFrame) -> DataFrame:
    """Adds ``file``, ``stem`` and ``folder`` (the last directory)."""
    return paths.withColumns({
        "file": F.regexp_extract("path", r"([^/]+)$", 1),
        "stem": F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1),
        "folder": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1),
    })


def split_images(paths: DataFrame, extensions: tuple[str, ...] = DATASET_IMAGES) -> DataFrame:
    """(split, stem, file) of paths like <root>/<split>/images/<file>."""
    kept = path_parts(with_extension(paths, extensions).filter(F.col("path").rlike(r"/[^/]+/images/[^/]+$")))
    return kept.select(F.regexp_extract("path", r"([^/]+)/images/[^/]+$", 1).alias("split"), "stem", "file")


def set_images(paths: DataFrame, sets: tuple[str, ...] | None = None,
               extensions: tuple[str, ...] = CARD_IMAGES) -> DataFrame:
    """(set_code, file) of paths like <root>/<set>/<file>."""
    kept = path_parts(with_extension(paths, extensions))
    if sets is not None:
        kept = kept.filter(F.col("folder").isin(list(sets)))
    return kept.select(F.col("folder").alias("set_code"), "file")


def list_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, bytes) of all files below the folders; contents are pruned from the scan."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
        .select("path", F.col("length").alias("bytes"))
    )
