"""Card catalog: one JSON array of cards with nested printings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.plans.running import Running, number_rows, running
from boxloom.schemas import CARD


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards (card_no, name, printings) of JSON array files; ``card_no`` is the file order.

    A file that is one array is one record to this reader, so its cards arrive in order within
    one task; ``read_large_cards`` splits such a file. Numbers run on over several files in order of their path.
    """
    cards = spark.read.schema(CARD).option("multiLine", True).json(path).select(
        "name", "printings", F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("_at"))
    numbered = number_rows(cards, [], F.col("_file"), [F.col("_file"), F.col("_at")], "_n")
    return numbered.select((F.col("_n") - 1).alias("card_no"), "name", "printings")


def read_large_cards(spark: SparkSession, path: str) -> DataFrame:
    """``read_cards`` for array files of any size, read by as many tasks as they have blocks.

    Text is cut at every closing brace, wherever blocks begin. Whether a piece starts inside a
    string follows from the quotes before it, how deep it lies from the brackets before it, and
    which card it belongs to from the cards that end before it: three running sums over short
    columns. Pieces of a card are then put together again and parsed.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))
    place = ["_file", "_block", "_at"]
    plain = F.regexp_replace("value", r"(?s)\\.", "")

    def count(text: Column, characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")

    def rise(text: Column) -> Column:
        bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
        return count(bare, "{[") - count(bare, "]")

    marks = pieces.select(*place, count(plain, '"').alias("_quotes"), rise(plain).alias("_out"),
                          rise(F.regexp_replace(plain, r'^[^"]*("|$)', "")).alias("_in"))

    def run(df: DataFrame, name: str, value: Column, inclusive: bool = False) -> DataFrame:
        return running(df, ["_file"], F.col("_block"), [F.col("_block"), F.col("_at")], **{name: Running("sum", value, inclusive)})

    quoted = run(marks, "_before", F.col("_quotes")).withColumns({
        "_closes": (F.col("_before") + F.col("_quotes")) % 2 == 0,
        "_rise": F.when(F.col("_before") % 2 == 0, F.col("_out")).otherwise(F.col("_in"))})
    closed = F.when(F.col("_closes"), 1).otherwise(0)
    deep = run(quoted, "_depth", F.col("_rise") - closed, inclusive=True)
    ends = F.col("_closes") & (F.col("_depth") == 1)
    owned = run(deep.withColumn("_end", ends), "_card", F.when(F.col("_end"), 1).otherwise(0)).select(*place, "_card", "_end")
    parts = pieces.join(owned, place).groupBy("_file", "_card").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_at", "value")))["value"].alias("_parts"), F.max("_end").alias("_whole"))
    text = F.regexp_replace(F.concat(F.array_join("_parts", "}"), F.lit("}")), r"^[\s,\[]+", "")
    cards = parts.where("_whole").select("_file", "_card", F.from_json(text, CARD).alias("_c"))
    # Numbers go on over several files in order of their path.
    files = owned.groupBy("_file").agg(F.sum(F.when(F.col("_end"), 1).otherwise(0)).alias("_n"))
    offsets = running(files, [], F.lit(0), [F.col("_file")], _first=Running("sum", F.col("_n"), inclusive=False))
    return cards.join(offsets.select("_file", "_first"), "_file").select(
        (F.col("_first") + F.col("_card")).alias("card_no"), "_c.name", "_c.printings")


def printings(cards: DataFrame) -> DataFrame:
    """One row per printing with its position; cards without printings give no row."""
    return cards.select("card_no", "name", F.posexplode("printings").alias("pos", "_p")).select(
        "card_no", "name", "pos", "_p.id", "_p.set_id", "_p.image_url")
