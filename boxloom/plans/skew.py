"""Plan shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.session import durable

BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a join side whose row count was checked, else no hint.

    Beyond the bound the join is left to a shuffle, where adaptive execution splits
    skewed partitions.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on ``keys`` that also pairs nulls."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left keys only."""
    renamed = right.select(*[
        F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns
    ])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key has at most ``limit`` rows, and the rest (None when there is no rest).

    One counting pass over the key columns; the count is combined map-side, so a hot key
    costs one row per map task. The list of hot keys holds at most rows/limit entries.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > limit).select(*keys)
    if not hot.take(1):
        return df, None
    hot = small_side(durable(hot, "hot-keys"))
    return join_on(df, hot, keys, "left_anti"), join_on(df, hot, keys, "left_semi")


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, written; None if there are none. One pass over the key columns."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = durable(counts.filter(F.col("_n") > limit).select(*keys), "hot-keys")
    return hot if hot.take(1) else None


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          salts: int = 1) -> DataFrame:
    """First ``k`` rows per key in ``order`` (which must be total).

    Ranking filters are applied before the shuffle by the engine, so a map task sends at
    most ``k`` rows of a key. With ``salts`` > 1 a key is first cut in ``salts`` parts,
    so that one task never sees more than ``salts * k`` rows of it at the end.
    """
    cut = df
    if salts > 1:
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        cut = (
            cut.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
            .withColumn("_rn", F.row_number().over(part))
            .filter(F.col("_rn") <= k)
            .drop("_rn", "_salt")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= k).drop("_rn")
