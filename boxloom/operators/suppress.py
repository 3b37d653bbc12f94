"""Greedy overlap removal, best box first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxloom.functions.geometry import box, overlaps_more
from boxloom.operators.overlap import tiled_pairs
from boxloom.plans.running import value_bucket
from boxloom.plans.skew import join_on, split_hot, top_k
from boxloom.session import drop_tables, durable, scratch_path

GROUP_LIMIT = 2_000
#: Boxes a group has in the first band of ranks, and how many times larger the next bands are.
_CHUNK, _GROWTH = 500, 8
#: Rows drawn to find where a band ends.
_DRAWN = 400
_SALTS = 64
#: Boxes of a block of neighbours that one task decides together.
_BLOCK = 2_048


def _row(order: list[Column], columns: list[str]) -> Column:
    return F.struct(
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_at"),
        *[F.col(c) for c in columns],
    )


def fold_boxes(ordered: Column, threshold: float, same: str | None = None) -> Column:
    """Boxes of a sorted array that overlap no kept box before them by more than the threshold.

    With ``same`` only boxes that agree in that field suppress each other.
    """
    def clear(b: Column, k: Column) -> Column:
        free = ~overlaps_more(box(b), box(k), threshold)
        return free if same is None else (b[same] != k[same]) | free

    return F.aggregate(
        ordered,
        F.filter(ordered, lambda _: F.lit(False)),
        lambda kept, b: F.when(
            F.forall(kept, lambda k: clear(b, k)), F.concat(kept, F.array(b))).otherwise(kept),
    )


def _kept_arrays(df: DataFrame, keys: list[str], order: list[Column], threshold: float,
                 max_keep: int | None) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(
        fold_boxes(F.sort_array(F.collect_list(_row(order, rest))), threshold).alias("kept"))
    if max_keep is not None:
        kept = kept.withColumn("kept", F.slice("kept", 1, max_keep))
    return kept


def _unpacked(arrays: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return arrays.select(*keys, F.explode("kept").alias("_b")).select(
        *[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in columns])


def _rank(order: list[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def _bounds(rows: DataFrame, kind: StructType, sizes: list[int]) -> list[Column]:
    """Ranks which about ``sizes`` of the best rows do not pass, found on a draw for each.

    Any bound gives the same result; the draw only sets how large the bands come out.
    """
    n = rows.count()
    bounds = []
    for size in (s for s in sizes if s < n):
        drawn = rows.select("_rank").sample(min(1.0, _DRAWN / size), seed=size).orderBy("_rank").limit(_DRAWN).collect()
        if drawn:
            bounds.append(F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(drawn[-1]["_rank"], kind.fields)]))
    return bounds


def _level(side: Column) -> Column:
    """Power of two that is no smaller than a side."""
    return F.ceil(F.log2(F.greatest(side.cast("double"), F.lit(1.0)))).cast("int")


def _uncovered(rows: DataFrame, kept: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """``rows`` without those that a box of ``kept`` suppresses.

    A row lies in one cell, by its low corner, of a grid as wide as its longer side; a kept box goes
    to all cells whose rows it can meet, on the grids of rows alike enough in size to pass the threshold.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    placed = rows.withColumn("_l", _level(side)).withColumns({
        f"_t{c}": F.floor(F.col(f"{c}1") / F.pow(F.lit(2.0), F.col("_l"))) for c in "xy"})
    levels = sorted(r[0] for r in placed.select("_l").distinct().collect() if r[0] is not None)
    if not levels:
        return rows
    wide = F.pow(F.lit(2.0), F.col("_k_l"))

    def cells(c: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(f"_k_{c}1") / wide) - 1, F.floor(F.col(f"_k_{c}2") / wide)))

    over = kept.filter("x2 > x1 AND y2 > y1").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_k_{c}") for c in ("x1", "y1", "x2", "y2")],
        side.cast("double").alias("_side")).withColumn("_k_l", F.explode(F.array(*[F.lit(v) for v in levels])))
    over = over.filter((wide >= F.col("_side") * threshold) & (wide * threshold <= F.col("_side") * 2))
    over = over.withColumn("_k_tx", cells("x")).withColumn("_k_ty", cells("y")).drop("_side")
    meet = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.lit(True))
    for c in ("_l", "_tx", "_ty"):
        meet = meet & (F.col(c) == F.col(f"_k{c}"))
    return placed.join(over, meet & overlaps_more(box(), box(prefix="_k_"), threshold), "left_anti").select(*rows.columns)


def _peel(hot: DataFrame, keys: list[str], order: list[Column], threshold: float) -> DataFrame:
    """The same result for groups too large for one task.

    Boxes are cut by rank into bands, each a few times as large as all before it. A band loses the
    boxes which a kept box of an earlier band suppresses, once, and what is left of it is decided on
    its own overlapping pairs. Kept boxes overlap little, so they are few where boxes crowd, and a
    band comes to the pairs thinned out: neither the pairs nor what is read grows faster than the rows.
    """
    spark, columns = hot.sparkSession, hot.columns
    ranked = hot.withColumn("_rank", _rank(order))
    kind = ranked.schema["_rank"].dataType
    ranked = durable(ranked, "ranked")
    n, groups = ranked.count(), ranked.select(*keys).distinct().count()
    sizes = [_CHUNK * groups]
    while sizes[-1] < n:
        sizes.append(sizes[-1] * _GROWTH)
    bounds = _bounds(ranked, kind, sizes)
    band = reduce(lambda total, b: total + (F.col("_rank") > b).cast("int"), bounds, F.lit(0))
    path = scratch_path(spark, "bands")
    banded = ranked.select(*columns, band.alias("_band"))
    banded.write.partitionBy("_band").parquet(path)
    drop_tables(ranked)
    table = spark.read.schema(banded.schema).parquet(path)
    kept: list[DataFrame] = []
    for i in range(len(bounds) + 1):
        part = table.filter(F.col("_band") == i).select(*columns)
        if kept:
            part = _uncovered(part, reduce(DataFrame.unionByName, kept), keys, threshold)
        kept.append(durable(_by_pairs(part, keys, order, threshold), "kept"))
    return reduce(DataFrame.unionByName, kept)


def _blocks(rows: DataFrame, keys: list[str]) -> Column:
    """A block of neighbouring boxes for each row: strips of the canvas, cut along the strip.

    Block bounds follow the boxes, so a block holds about ``_BLOCK`` of them wherever they crowd.
    """
    low = rows.agg(*[F.min(c).alias(c) for c in ("x1", "y1")], F.max("x1").alias("right"), F.max("y1").alias("down"),
                   F.count(F.lit(1)).alias("n")).first()
    groups = rows.select(*keys).distinct().count()
    strips = max(1, round((low["n"] / max(1, groups) / _BLOCK) ** 0.5))
    height = max((low["down"] - low["y1"]) / strips, 1e-9)
    wide = float(low["right"] - low["x1"]) + 1.0
    along = F.floor((F.col("y1") - low["y1"]) / height) * wide + (F.col("x1") - low["x1"])
    return value_bucket(rows, along, rows=_BLOCK)


def _fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides the boxes of a block in order: kept, gone, or waiting for a box of another block.

    A box goes with the first kept box over it, and stays once all better boxes over it are gone.
    """
    for batch in batches:
        for ids, overs in zip(batch.column(0), batch.column(1)):
            state: dict[int, str] = {}
            for i, over in zip(ids.as_py(), overs.as_py()):
                met = {state.get(k, "open") for k in over or ()}
                state[i] = "gone" if "kept" in met else "open" if "open" in met else "kept"
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(state), pa.int64()), pa.array(list(state.values()), pa.string())], names=["_id", "_state"])


def _by_pairs(df: DataFrame, keys: list[str], order: list[Column], threshold: float) -> DataFrame:
    """Greedy removal on overlapping pairs: which box suppresses which is found once, on a grid.

    Boxes are dealt into blocks of neighbours. In each round a block decides all its boxes but those
    that wait for a better box of another block, so there are as many rounds as a chain of
    overlapping boxes crosses blocks, however many boxes it has.
    """
    rows = durable(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    if rows.isEmpty():
        return df
    rank = _rank(order)
    pairs = tiled_pairs(rows, rows, keys, "_id", "_id", once=True, above_iou=threshold).select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("_id").alias(side), rank.alias(f"{side}_rank")), side)
    first = F.col("a_rank") < F.col("b_rank")
    edges = durable(pairs.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")), "suppressing")
    undecided = durable(rows.select("_id", F.struct(*keys, _blocks(rows, keys).alias("_b")).alias("_block"), rank.alias("_rank")), "open")
    kept: list[DataFrame] = []
    while not undecided.isEmpty():
        above = edges.groupBy(F.col("worse").alias("_id")).agg(F.collect_list("better").alias("_over"))
        told = undecided.join(above, "_id", "left")
        # One array per block, in order; a block is bounded.
        listed = told.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_rank", "_id", "_over"))).alias("_l"))
        decided = durable(listed.select(F.col("_l._id").alias("_id"), F.col("_l._over").alias("_over")).mapInArrow(
            _fold_blocks, "_id bigint, _state string"), "decided")
        free = decided.where("_state = 'kept'").select("_id")
        kept.append(free)
        # Boxes of other blocks under a kept one go too.
        gone = decided.where("_state = 'gone'").select("_id").union(
            edges.join(free.select(F.col("_id").alias("better")), "better").select(F.col("worse").alias("_id"))).distinct()
        left = durable(undecided.join(free, "_id", "left_anti").join(gone, "_id", "left_anti"), "open")
        # Suppressed boxes suppress nothing.
        rest = durable(edges.join(left.select(F.col("_id").alias("better")), "better", "left_semi")
                       .join(left.select(F.col("_id").alias("worse")), "worse", "left_semi"), "suppressing")
        drop_tables(undecided, edges)
        undecided, edges = left, rest
    return rows.join(reduce(DataFrame.unionByName, kept), "_id", "left_semi").drop("_id")


def keep_best(df: DataFrame, keys: list[str], order: list[Column], threshold: float,
              max_keep: int | None = None, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Boxes kept per key: in ``order``, a box stays if no kept box overlaps it by more than
    ``threshold``; at most ``max_keep`` of them.

    ``df`` holds x1, y1, x2, y2; ``order`` must be total within a key. Groups up to
    ``group_limit`` are folded in the JVM after one shuffle; larger ones are peeled in
    bands of ranks with the same result.
    """
    usual, hot = split_hot(df, keys, group_limit)
    kept = _unpacked(_kept_arrays(usual, keys, order, threshold, max_keep), keys, df.columns)
    if hot is None:
        return kept
    peeled = _peel(hot, keys, order, threshold)
    if max_keep is not None:
        peeled = top_k(peeled, keys, order, max_keep, _SALTS)
    return kept.unionByName(peeled)


def kept_per_group(df: DataFrame, keys: list[str], order: list[Column], threshold: float,
                   max_keep: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """As ``keep_best``, but one row per key with the ordered array ``kept``, which
    ``max_keep`` bounds."""
    usual, hot = split_hot(df, keys, group_limit)
    arrays = _kept_arrays(usual, keys, order, threshold, max_keep)
    if hot is None:
        return arrays
    rest = [c for c in df.columns if c not in keys]
    peeled = top_k(_peel(hot, keys, order, threshold), keys, order, max_keep, _SALTS)
    return arrays.unionByName(peeled.groupBy(*keys).agg(
        F.sort_array(F.collect_list(_row(order, rest))).alias("kept")))
