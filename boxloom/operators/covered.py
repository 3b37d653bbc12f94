"""Covered area of boxes by a sweep over sorted edges, cut into tiles that follow the rectangles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from boxloom.plans.skew import join_on, small_side
from boxloom.session import durable

CORNERS = ("x1", "y1", "x2", "y2")
#: Rectangles a tile is meant to hold, and boxes that meet them at a time.
TILE_RECTS, CHUNK_BOXES = 128, 131_072

_CELLS = 1 << 19  # cells of the sweep that are held at a time
_STEPS = 64       # most tiles along a side of one canvas
_PIXELS = 384     # a tile this wide has few cells however many edges it holds, and is not cut on


def covered_area(rects: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Pixels of each box (n x 4 corners) under the union of ``rects``.

    Edges are sorted into a grid of columns and rows. The sweep goes over blocks of columns and
    carries, per row, how many rectangles are open, the covered width so far, and the area so
    far; area to the left of and above a point is linear within a cell, so a box is four looks.
    """
    hidden = np.zeros(len(boxes), np.int64)
    rects = rects[(rects[:, 2] > rects[:, 0]) & (rects[:, 3] > rects[:, 1])]
    if not len(rects) or not len(boxes):
        return hidden
    around = np.concatenate([rects[:, :2].min(axis=0), rects[:, 2:].max(axis=0)])
    if (rects == around).all(axis=1).any():
        rects = around[None]  # one rectangle holds all the others
    xs, ys = np.unique(rects[:, [0, 2]]), np.unique(rects[:, [1, 3]])
    left, right = np.searchsorted(xs, rects[:, 0]), np.searchsorted(xs, rects[:, 2])
    top, end = np.searchsorted(ys, rects[:, 1]), np.searchsorted(ys, rects[:, 3])
    at = np.concatenate([left, left, right, right])
    row = np.concatenate([top, end, top, end])
    sign = np.repeat([1, -1, -1, 1], len(rects))
    order = np.argsort(at, kind="stable")
    at, row, sign = at[order], row[order], sign[order]

    inside = np.clip(boxes, around[[0, 1, 0, 1]], around[[2, 3, 2, 3]])
    px, py = inside[:, [0, 0, 2, 2]].ravel(), inside[:, [1, 3, 1, 3]].ravel()
    value = np.tile([1, -1, -1, 1], len(boxes))
    i = np.clip(np.searchsorted(xs, px, "right") - 1, 0, len(xs) - 2)
    j = np.clip(np.searchsorted(ys, py, "right") - 1, 0, len(ys) - 2)
    points = np.argsort(i, kind="stable")
    total = np.zeros(len(px), np.int64)

    wide, tall = np.diff(xs), np.diff(ys)
    opened = np.zeros(len(ys), np.int64)
    width, area = np.zeros(len(tall), np.int64), np.zeros(len(ys), np.int64)
    step = max(1, _CELLS // len(ys))
    for low in range(0, len(wide), step):
        high = min(low + step, len(wide))
        a, b = np.searchsorted(at, [low, high])
        change = np.zeros((high - low, len(ys)), np.int64)
        np.add.at(change, (at[a:b] - low, row[a:b]), sign[a:b])
        change[0] += opened
        count = change.cumsum(axis=0)
        opened = count[-1]
        solid = (count.cumsum(axis=1) > 0)[:, :-1]
        columns = wide[low:high, None]
        height = np.pad((solid * tall).cumsum(axis=1), ((0, 0), (1, 0)))
        widths = np.concatenate([width[None], width + (solid * columns).cumsum(axis=0)])
        areas = np.concatenate([area[None], area + (height * columns).cumsum(axis=0)])
        p, q = np.searchsorted(i[points], [low, high])
        some = points[p:q]
        c, r = i[some] - low, j[some]
        dx, dy = px[some] - xs[i[some]], py[some] - ys[r]
        total[some] = areas[c, r] + dx * height[c, r] + dy * widths[c, r] + dx * dy * solid[c, r]
        width, area = widths[-1], areas[-1]
    return (total * value).reshape(-1, 4).sum(axis=1)


def _chosen(found: str, end: str, n: Column) -> Column:
    """Cuts of one axis: the lowest start, as many quantiles of starts as tiles call for, the last end."""
    inner = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col(found), F.floor(i * _STEPS / n).cast("int")))
    return F.array_sort(F.array_distinct(F.concat(inner, F.array(F.col(end)))))


def _in_tiles(df: DataFrame) -> DataFrame:
    """Each shape cut at the tiles it touches. Tile ``i`` goes from cut ``i - 1`` to cut ``i``."""
    def tiles(cuts: str, low: str, high: str) -> Column:
        return F.explode(F.sequence(F.size(F.filter(cuts, lambda c: c <= F.col(low))),
                                    F.size(F.filter(cuts, lambda c: c < F.col(high)))))

    spread = df.withColumn("_i", tiles("_cx", "x1", "x2")).withColumn("_j", tiles("_cy", "y1", "y2"))
    return spread.withColumns({  # the outer tiles have no cut on one side; nulls are passed over
        "x1": F.greatest("x1", F.get("_cx", F.col("_i") - 1)), "x2": F.least("x2", F.get("_cx", F.col("_i"))),
        "y1": F.greatest("y1", F.get("_cy", F.col("_j") - 1)), "y2": F.least("y2", F.get("_cy", F.col("_j")))})


def _sweep(keys: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def numbers(table: pa.Table) -> np.ndarray:
        return np.column_stack([table.column(c).to_numpy() for c in CORNERS]).astype(np.int64)

    def sweep(boxes: pa.Table, rects: pa.Table) -> pa.Table:
        hidden = covered_area(numbers(rects), numbers(boxes))
        columns = [boxes.column(k) for k in keys] + [boxes.column(f"_{c}") for c in CORNERS]
        return pa.Table.from_arrays([*columns, pa.array(hidden)], names=[*keys, *CORNERS, "hidden"])

    return sweep


def hidden_in_tiles(boxes: DataFrame, occluders: DataFrame, keys: list[str],
                    tile_rects: int = TILE_RECTS, chunk_boxes: int = CHUNK_BOXES) -> DataFrame:
    """Shapes of ``boxes`` (keys, whole-pixel corners) with ``hidden``, where it is not zero.

    A canvas is cut at quantiles of its occluders' starts, into more tiles the more occluders it
    has, down to tiles whose pixels bound the sweep; smaller ones would only repeat each box more often. Equal shapes count once, also after cutting, so rectangles over a whole tile become one
    before the shuffle. Boxes of a crowded tile are dealt into chunks by hash; each meets the tile's
    occluders. The work depends on the number of edges, not on the size in pixels.
    """
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    rects = durable(occluders.filter(solid).select(*keys, *CORNERS).distinct(), "rectangles")
    shapes = durable(boxes.filter(solid).select(*keys, *CORNERS).distinct(), "shapes")
    steps = F.array(*[F.lit(k / _STEPS) for k in range(_STEPS)])
    side = F.least(F.lit(_STEPS), F.ceil(F.sqrt(F.col("_n") / tile_rects))).cast("int")
    cuts = rects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("x1", steps).alias("_qx"), F.max("x2").alias("_ex"),
        F.percentile_approx("y1", steps).alias("_qy"), F.max("y2").alias("_ey"),
        *[F.min(c).alias(f"_s{c[0]}") for c in ("x1", "y1")])

    def tiles(c: str) -> Column:
        return F.least(side, F.greatest(F.lit(1), F.ceil((F.col(f"_e{c}") - F.col(f"_s{c}")) / _PIXELS)).cast("int"))

    cuts = small_side(durable(cuts.select(
        *keys, _chosen("_qx", "_ex", tiles("x")).alias("_cx"), _chosen("_qy", "_ey", tiles("y")).alias("_cy")), "cuts"))

    tile = [*keys, "_i", "_j"]
    group = [*tile, "_chunk"]
    dealt = durable(_in_tiles(join_on(shapes, cuts, keys).withColumns({f"_{c}": F.col(c) for c in CORNERS})).select(
        *tile, *CORNERS, *[f"_{c}" for c in CORNERS]), "dealt")
    chunks = small_side(durable(dealt.groupBy(*tile).agg(
        F.ceil(F.count(F.lit(1)) / chunk_boxes).cast("int").alias("_chunks")), "chunks"))
    parts = join_on(_in_tiles(join_on(rects, cuts, keys)).select(*tile, *CORNERS).distinct(), chunks, tile).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    dealt = join_on(dealt, chunks, tile).withColumn(
        "_chunk", F.pmod(F.xxhash64(*[f"_{c}" for c in CORNERS]), F.col("_chunks")).cast("int"))
    out = StructType([*shapes.schema.fields, StructField("hidden", LongType())])
    swept = dealt.select(*group, *CORNERS, *[f"_{c}" for c in CORNERS]).groupBy(*group).cogroup(
        parts.select(*group, *CORNERS).groupBy(*group)).applyInArrow(
        _sweep(keys), out)
    return swept.groupBy(*keys, *CORNERS).agg(F.sum("hidden").alias("hidden")).filter("hidden > 0")
