"""Class registries: ordered lists whose position is the class id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.names import canonical_name
from boxloom.plans.running import BUCKET_WIDTH, Running, number_rows, running
from boxloom.plans.skew import small_side


def _block(pos: Column) -> Column:
    return F.floor(pos / BUCKET_WIDTH)


def first_positions(names: DataFrame, order: list[str]) -> DataFrame:
    """Each name once, at its first position (combined before the shuffle)."""
    return names.groupBy("name").agg(
        F.min(F.struct(*order)).alias("_first")
    ).select("name", *[F.col(f"_first.{c}").alias(c) for c in order])


def clean_class_list(raw: DataFrame) -> DataFrame:
    """Registry of (pos, raw_name): canonical names, first of each kept, renumbered from 0."""
    names = raw.select(canonical_name(F.col("raw_name")).alias("name"), F.col("pos").cast("bigint"))
    firsts = first_positions(names, ["pos"])
    numbered = number_rows(firsts, [], _block(F.col("pos")), [F.col("pos")], "_n")
    return numbered.select((F.col("_n") - 1).alias("class_id"), "name")


def id_map(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Old position to new id, for labels written under the raw list."""
    old = raw.select(F.col("pos").cast("bigint").alias("old_id"),
                     canonical_name(F.col("raw_name")).alias("name"))
    return old.join(registry, "name").select("old_id", "class_id")


def discovered_classes(files: DataFrame, sets: list[str]) -> DataFrame:
    """Sorted canonical names of the PNG files (set_code, file) of the wanted sets."""
    stem = F.regexp_extract("file", r"^(?s)(.*)\.[^.]*$", 1)
    return (
        files.filter(F.col("set_code").isin(sets) & F.lower("file").endswith(".png"))
        .select(canonical_name(stem).alias("name")).distinct().orderBy("name")
    )


def in_name_order(names: DataFrame) -> DataFrame:
    """Names with their 0-based alphabetical position."""
    numbered = number_rows(
        names.select("name"), [], F.substring("name", 1, 3), [F.col("name")], "_n")
    return numbered.select("name", (F.col("_n") - 1).alias("pos"))


def in_discovery_order(files: DataFrame) -> DataFrame:
    """Canonical names of (pos, raw_name) at their first position."""
    names = files.select(canonical_name(F.col("raw_name")).alias("name"), F.col("pos").cast("bigint"))
    return first_positions(names, ["pos"])


def extend_registry(registry: DataFrame, discovered: DataFrame) -> DataFrame:
    """Registered names keep their id; other names of (pos, name) follow in order of ``pos``.

    New ids continue after the highest registered id, which the running maximum carries
    across, so the two parts need no join with a single-row aggregate.
    """
    tagged = registry.select(
        "name", F.lit(0).alias("source"), F.col("class_id").alias("pos"), "class_id",
    ).unionByName(discovered.select(
        "name", F.lit(1).alias("source"), F.col("pos").cast("bigint").alias("pos"),
        F.lit(None).cast("bigint").alias("class_id")))
    both = tagged.groupBy("name").agg(
        F.min(F.struct("source", "pos", "class_id")).alias("_f")).select("name", "_f.*")
    ranked = running(
        both, [], F.struct(F.col("source"), _block(F.col("pos"))), [F.col("source"), F.col("pos")],
        _last=Running("max", F.col("class_id")),
        _new=Running("sum", F.col("source").cast("bigint")),
    )
    added = F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_new")
    return ranked.select(
        F.coalesce(F.col("class_id"), added).cast("bigint").alias("class_id"), "name",
        (F.col("source") == 1).alias("added"),
    )


def merged_class_list(registered: DataFrame, discovered: DataFrame) -> DataFrame:
    """Ordered union of two (pos, name) lists, first list first, renumbered from 0."""
    both = registered.select("name", F.lit(0).alias("source"), F.col("pos").cast("bigint").alias("pos")) \
        .unionByName(discovered.select("name", F.lit(1).alias("source"), F.col("pos").cast("bigint").alias("pos")))
    firsts = first_positions(both, ["source", "pos"])
    numbered = number_rows(
        firsts, [], F.struct(F.col("source"), _block(F.col("pos"))),
        [F.col("source"), F.col("pos")], "_n")
    return numbered.select((F.col("_n") - 1).alias("class_id"), "name")


def names_not_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct names of ``left`` that ``right`` lacks."""
    return left.select("name").distinct().join(right.select("name"), "name", "left_anti")


def list_differences(lists: dict[str, DataFrame]) -> DataFrame:
    """Entries (pos, name) that some of the named lists lack; empty when all lists agree.

    One aggregation over the union shows every difference of any number of lists.
    """
    tagged = reduce(DataFrame.unionByName, [
        df.select(F.col("pos").cast("bigint").alias("pos"), "name", F.lit(label).alias("source"))
        for label, df in lists.items()
    ])
    present = {label: F.max(F.when(F.col("source") == label, 1).otherwise(0)) for label in lists}
    return (
        tagged.groupBy("pos", "name")
        .agg(*[c.alias(f"in_{label}") for label, c in present.items()])
        .filter(reduce(lambda a, b: a + b, [F.col(f"in_{l}") for l in lists]) < len(lists))
    )


def class_usage(registry: DataFrame, used: DataFrame) -> DataFrame:
    """Every registered class as used or unused, given distinct used ids."""
    marks = used.select("class_id", F.lit("used").alias("_s"))
    return registry.join(marks, "class_id", "left").select(
        "class_id", "name", F.coalesce(F.col("_s"), F.lit("unused")).alias("status"))


def used_classes(registry: DataFrame, used: DataFrame) -> DataFrame:
    return registry.join(used.select("class_id"), "class_id", "left_semi")


def unused_classes(registry: DataFrame, used: DataFrame) -> DataFrame:
    return registry.join(used.select("class_id"), "class_id", "left_anti")


def with_class_ids(named: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows whose ``name`` is registered, with its class id."""
    return named.join(small_side(registry.select("name", "class_id")), "name")


def with_class_labels(rows: DataFrame, names: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """``label`` of each ``class_id``: preferred list, then general list, then the id as text."""
    found = F.col("_name")
    out = rows.join(
        small_side(names.select("class_id", F.col("name").alias("_name"))), "class_id", "left")
    if preferred is not None:
        out = out.join(
            small_side(preferred.select("class_id", F.col("name").alias("_own"))), "class_id", "left")
        found = F.coalesce(F.col("_own"), found)
    return out.withColumn("label", F.coalesce(found, F.col("class_id").cast("string"))) \
        .drop("_name", "_own")
