"""Lookups of names, ids, pointer positions and hovered boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import box, contains
from boxloom.functions.names import exact_key, loose_key, search_key
from boxloom.plans.running import VALUE_ROWS, Running, running, value_bucket
from boxloom.plans.skew import join_on
from boxloom.session import durable


def url_tables(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First card with printings per exact key and per loose key, of (card_no, name, printings)."""
    usable = cards.filter(F.size("printings") > 0).select(
        exact_key(F.col("name")).alias("_exact"),
        F.struct("card_no", F.get("printings", F.lit(0))["image_url"].alias("image_url")).alias("_hit"))
    loose = usable.select(loose_key(F.col("_exact")).alias("_loose"), "_hit")
    return (
        usable.groupBy("_exact").agg(F.min("_hit").alias("_by_exact")),
        loose.groupBy("_loose").agg(F.min("_hit").alias("_by_loose")),
    )


def urls_by_name(names: DataFrame, cards: DataFrame) -> DataFrame:
    """``names`` (name) with the first printing's URL of the first matching card.

    A card matches by exact or by punctuation-free key; catalog order alone decides
    between the two. The catalog is reduced to one row per key before the joins.
    """
    by_exact, by_loose = url_tables(cards)
    keyed = names.withColumn("_exact", search_key(F.col("name"))).withColumn(
        "_loose", loose_key(F.col("_exact")))
    hit = F.least("_by_exact", "_by_loose")
    return (
        keyed.join(by_exact, "_exact", "left").join(by_loose, "_loose", "left")
        .withColumn("card_no", hit["card_no"]).withColumn("image_url", hit["image_url"])
        .drop("_exact", "_loose", "_by_exact", "_by_loose")
    )


def urls_by_id(ids: DataFrame, printings: DataFrame) -> DataFrame:
    """``ids`` (id) with the URL of the first printing of that id in any letter case."""
    firsts = printings.groupBy(F.upper(F.coalesce("id", F.lit(""))).alias("_key")).agg(
        F.min(F.struct("card_no", "pos", "image_url")).alias("_hit"))
    return (
        ids.withColumn("_key", F.upper("id")).join(firsts, "_key", "left")
        .withColumn("image_url", F.col("_hit.image_url")).drop("_key", "_hit")
    )


def last_known(events: DataFrame, readings: DataFrame, session: str, ts: str,
               values: dict[str, object], tie: str = "event_id", rows: int = VALUE_ROWS) -> DataFrame:
    """``events`` with the latest reading at or before their time; defaults before the first.

    ``values`` maps reading columns to defaults. Both inputs run together in time order, cut into
    buckets at times taken from the data, about ``rows`` rows each, so a session is spread however
    many of its rows fall into a short time. They are written once, since times and rows are read
    apart.
    """
    names = list(values)
    carried = F.struct(*[F.col(n) for n in names])
    both = events.select("*", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_tie"),
                         F.lit(None).cast(readings.select(carried).schema[0].dataType).alias("_seen")) \
        .unionByName(
            readings.select(session, ts, F.lit(0).alias("_kind"), F.col(tie).cast("bigint").alias("_tie"),
                            carried.alias("_seen")),
            allowMissingColumns=True)
    both = durable(both, "in-time-order")
    bucket = value_bucket(both, F.col(ts).cast("timestamp").cast("double"), rows)
    ran = running(both, [session], bucket, [F.col(ts), F.col("_kind"), F.col("_tie")],
                  _now=Running("last", F.col("_seen")))
    return ran.filter(F.col("_kind") == 1).select(
        *events.columns,
        *[F.coalesce(F.col(f"_now.{n}"), F.lit(v)).alias(n) for n, v in values.items()])


def first_hovered(kept: Column, px: Column, py: Column) -> Column:
    """First box of an ordered array that holds the point; null if none does."""
    return F.get(F.filter(kept, lambda b: contains(box(b), px, py)), F.lit(0))


def hovered_boxes(frames: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """``frames`` (keys, px, py) with ``hit``, the box under the pointer in detection order.

    ``kept`` holds one bounded array per key (see ``kept_per_group``), so a key that many
    frames show meets one row and no pair of frame and box is ever produced.
    """
    return join_on(frames, kept, keys, "left").withColumn(
        "hit", first_hovered(F.col("kept"), F.col("px"), F.col("py"))).drop("kept")
