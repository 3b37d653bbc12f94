"""Per-image statistics of normalized boxes, used to size the cards laid into a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.plans.running import Running, exact_median, running, value_bucket
from boxloom.plans.skew import join_on, small_side, split_hot
from boxloom.session import durable

GROUP_LIMIT = 20_000

# Band around the median area, card shape, size without boxes, highlight
# factor, native aspect of the screen, lower bound and factor of tall boxes.
BAND_LOW, BAND_HIGH = 0.9, 1.1
CARD_ASPECT = 1.4
DEFAULT_WIDTH, DEFAULT_HEIGHT = 300.0, 420.0
HIGHLIGHT_FACTOR = 1.5
ASPECT_SCALE = 1920.0 / 1080.0
TALL_ASPECT, TALL_FACTOR = 1.5, 2.4


def _median(ordered: Column) -> Column:
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return (low + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def _sizes(stats: DataFrame) -> DataFrame:
    """Final columns from n, min_height, median_area, band_n, band_w, band_h, trimmed, tall."""
    enough = F.col("band_n") >= F.greatest(F.lit(3), F.floor(F.col("n") / 3))
    square = F.sqrt(F.col("median_area") * F.col("width") * F.col("height") / CARD_ASPECT)
    empty = F.col("n") == 0
    mean_aspect = F.coalesce(F.col("trimmed"), F.lit(1.0)) * ASPECT_SCALE
    return stats.select(
        *[c for c in stats.columns if c not in
          ("n", "min_height", "median_area", "band_n", "band_w", "band_h", "trimmed", "tall",
           "width", "height")],
        F.col("n").cast("bigint").alias("boxes"),
        F.coalesce(F.col("min_height"), F.lit(1.0)).alias("min_height"),
        F.col("median_area"),
        F.when(empty, DEFAULT_WIDTH).when(enough, F.col("band_w") * F.col("width"))
        .otherwise(square).alias("target_w"),
        F.when(empty, DEFAULT_HEIGHT).when(enough, F.col("band_h") * F.col("height"))
        .otherwise(square * CARD_ASPECT).alias("target_h"),
        (F.col("median_area") * HIGHLIGHT_FACTOR).alias("highlight_above"),
        mean_aspect.alias("mean_aspect"),
        F.coalesce(F.col("tall") * ASPECT_SCALE, mean_aspect * TALL_FACTOR).alias("tall_aspect"),
    )


def _folded(images: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    grouped = boxes.groupBy(*keys).agg(F.collect_list(F.struct("w", "h")).alias("_b"))
    out = join_on(images, grouped, keys, "left").withColumn(
        "_b", F.coalesce("_b", F.array().cast("array<struct<w:double,h:double>>")))
    out = out.withColumns({
        "n": F.size("_b"),
        "min_height": F.array_min(F.transform("_b", lambda b: b["h"])),
        "median_area": _median(F.sort_array(F.transform("_b", lambda b: b["w"] * b["h"]))),
        "_aspects": F.sort_array(F.transform(
            F.filter("_b", lambda b: b["w"] > 0), lambda b: b["h"] / b["w"])),
    })
    out = out.withColumn("_band", F.filter("_b", lambda b: (b["w"] * b["h"]).between(
        F.col("median_area") * BAND_LOW, F.col("median_area") * BAND_HIGH)))
    low = F.floor(F.size("_aspects") * 0.25).cast("int")
    high = F.floor(F.size("_aspects") * 0.75).cast("int")
    return _sizes(out.withColumns({
        "band_n": F.size("_band"),
        "band_w": _median(F.sort_array(F.transform("_band", lambda b: b["w"]))),
        "band_h": _median(F.sort_array(F.transform("_band", lambda b: b["h"]))),
        "trimmed": _mean(F.when(high > low, F.slice("_aspects", low + 1, F.greatest(high - low, F.lit(0))))
                         .otherwise(F.col("_aspects"))),
        "tall": _mean(F.filter("_aspects", lambda a: a >= TALL_ASPECT)),
    }).drop("_b", "_aspects", "_band"))


def _ranked(images: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The same statistics by exact ranks, for images too large for one array."""
    sized = boxes.select(*keys, "w", "h", (F.col("w") * F.col("h")).alias("area"),
                         F.when(F.col("w") > 0, F.col("h") / F.col("w")).alias("aspect"))
    basic = sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("aspect").alias("_shaped"),
        F.min("h").alias("min_height"),
        F.avg(F.when(F.col("aspect") >= TALL_ASPECT, F.col("aspect"))).alias("tall"))
    medians = durable(exact_median(sized, keys, "area", "median_area"), "medians")
    band = join_on(sized, small_side(medians), keys).filter(F.col("area").between(
        F.col("median_area") * BAND_LOW, F.col("median_area") * BAND_HIGH))
    counted = sized.filter(F.col("aspect").isNotNull()).groupBy(*keys, "aspect").agg(
        F.count(F.lit(1)).alias("_c"))
    ranked = running(counted, keys, value_bucket(counted, F.col("aspect")), [F.col("aspect")],
                     _hi=Running("sum", F.col("_c")))
    low, high = F.floor(F.col("_shaped") * 0.25), F.floor(F.col("_shaped") * 0.75)
    inside = F.greatest(F.lit(0), F.least(F.col("_hi"), high) - F.greatest(F.col("_hi") - F.col("_c"), low))
    trimmed = join_on(ranked, basic.select(*keys, "_shaped"), keys).groupBy(*keys).agg(
        (F.sum(F.col("aspect") * inside) / F.sum(inside)).alias("trimmed"))
    out = join_on(images, basic.drop("_shaped"), keys)
    for part in (
        medians, trimmed,
        band.groupBy(*keys).agg(F.count(F.lit(1)).alias("band_n")),
        exact_median(band, keys, "w", "band_w"),
        exact_median(band, keys, "h", "band_h"),
    ):
        out = join_on(out, part, keys, "left")
    return _sizes(out.withColumn("band_n", F.coalesce("band_n", F.lit(0))))


def layout_stats(images: DataFrame, boxes: DataFrame, keys: list[str],
                 group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per image of ``images`` (keys, width, height) from its boxes (keys, w, h).

    Columns: boxes, min_height, median_area, target_w, target_h, highlight_above,
    mean_aspect, tall_aspect. One shuffle for usual images; images with more boxes than
    ``group_limit`` are ranked in two levels instead.
    """
    usual, hot = split_hot(boxes.select(*keys, "w", "h"), keys, group_limit)
    if hot is None:
        return _folded(images, usual, keys)
    hot_keys = hot.select(*keys).distinct()
    return _folded(join_on(images, hot_keys, keys, "left_anti"), usual, keys).unionByName(
        _ranked(join_on(images, hot_keys, keys, "left_semi"), hot, keys))
