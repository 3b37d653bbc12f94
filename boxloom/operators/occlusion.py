"""Share of each box hidden by the union of occluding rectangles, in whole pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.operators.covered import CORNERS, hidden_in_tiles
from boxloom.plans.skew import join_on, split_hot

GROUP_LIMIT = 64
# Fixed value: a label is dropped from this hidden share on.
DROP_SHARE = 0.85


def _pieces(rects: str, edges: str) -> Column:
    """The union of rectangles as disjoint ones: strips between edges, spans within a strip."""
    def spans(top: Column, end: Column) -> Column:
        across = F.sort_array(F.transform(
            F.filter(rects, lambda r: (r["y1"] <= top) & (r["y2"] >= end)),
            lambda r: F.struct(r["x1"].alias("a"), r["x2"].alias("b"))))
        start = F.struct(
            F.lit(-(2 ** 62)).cast("bigint").alias("to"),
            F.array().cast("array<struct<x1:bigint,x2:bigint>>").alias("out"))
        return F.aggregate(
            across, start,
            lambda s, r: F.struct(
                F.greatest(s["to"], r["b"]).alias("to"),
                F.when(r["b"] > s["to"], F.concat(s["out"], F.array(F.struct(
                    F.greatest(r["a"], s["to"]).alias("x1"), r["b"].alias("x2"))))
                ).otherwise(s["out"]).alias("out")),
            lambda s: s["out"])

    def strip(top: Column, i: Column) -> Column:
        end = F.get(F.col(edges), i + 1)
        return F.transform(spans(top, end), lambda p: F.struct(
            p["x1"].alias("x1"), top.alias("y1"), p["x2"].alias("x2"), end.alias("y2")))

    return F.flatten(F.transform(F.slice(edges, 1, F.size(edges) - 1), strip))


def _by_strips(boxes: DataFrame, occluders: DataFrame, keys: list[str]) -> DataFrame:
    """Each image's occluders become disjoint pieces once; a box then adds up its shares."""
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    pieces = (
        occluders.filter(solid).groupBy(*keys)
        .agg(F.collect_list(F.struct(*CORNERS)).alias("_r"))
        .withColumn("_e", F.sort_array(F.array_distinct(F.concat(
            F.transform("_r", lambda r: r["y1"]), F.transform("_r", lambda r: r["y2"])))))
        .select(*keys, _pieces("_r", "_e").alias("_pieces"))
    )
    zero = F.lit(0).cast("bigint")

    def share(r: Column) -> Column:
        wide = F.least(F.col("x2"), r["x2"]) - F.greatest(F.col("x1"), r["x1"])
        tall = F.least(F.col("y2"), r["y2"]) - F.greatest(F.col("y1"), r["y1"])
        return F.greatest(zero, wide) * F.greatest(zero, tall)

    hidden = F.aggregate("_pieces", zero, lambda total, r: total + share(r))
    return join_on(boxes, pieces, keys, "left").withColumn(
        "hidden", F.coalesce(hidden, zero)).drop("_pieces")


def _by_tiles(boxes: DataFrame, occluders: DataFrame, keys: list[str]) -> DataFrame:
    """The same count by a sweep over tiles, for images with very many occluders."""
    return join_on(boxes, hidden_in_tiles(boxes, occluders, keys), [*keys, *CORNERS], "left").withColumn(
        "hidden", F.coalesce("hidden", F.lit(0)).cast("bigint"))


def _whole_pixels(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in CORNERS})


def hidden_area(boxes: DataFrame, occluders: DataFrame, keys: list[str],
                group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``boxes`` with ``hidden``, the pixels covered by any occluder of the same key.

    Corners are cut to whole pixels first, on either path. Usual images carry their occluders as one short array to
    each box; images with more than ``group_limit`` occluders are swept in tiles.
    """
    boxes, occluders = _whole_pixels(boxes), _whole_pixels(occluders)
    usual, hot = split_hot(occluders, keys, group_limit)
    if hot is None:
        return _by_strips(boxes, usual, keys)
    hot_keys = hot.select(*keys).distinct()
    return _by_strips(join_on(boxes, hot_keys, keys, "left_anti"), usual, keys).unionByName(
        _by_tiles(join_on(boxes, hot_keys, keys, "left_semi"), hot, keys))


def visible_labels(boxes: DataFrame, occluders: DataFrame, keys: list[str], width: int,
                   height: int, drop_share: float = DROP_SHARE,
                   group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Boxes that stay labelled: clamped to the canvas, not empty, hidden below ``drop_share``."""
    clamped = boxes.withColumns({
        "x1": F.greatest(F.lit(0), F.col("x1")), "y1": F.greatest(F.lit(0), F.col("y1")),
        "x2": F.least(F.lit(width - 1), F.col("x2")), "y2": F.least(F.lit(height - 1), F.col("y2")),
    }).withColumns({c: F.col(c).cast("bigint") for c in CORNERS})
    solid = clamped.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return hidden_area(solid, occluders, keys, group_limit).filter(F.col("hidden") / area < drop_share)
