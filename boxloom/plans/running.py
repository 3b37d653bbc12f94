"""Running values in two levels, so that no task needs all rows of a key.

A window over a key puts the whole key in one task. Here rows are first put in ordered
buckets of their key. Each bucket is summarized (map-side combined), the summaries are
run over per key (few rows), and rows only run within their own bucket. The two parts
are then combined. The result equals the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.plans.skew import join_on

BUCKET_WIDTH = 65_536
#: Rows a bucket of ``value_bucket`` aims at, and the most buckets it makes.
VALUE_ROWS, VALUE_BUCKETS = 65_536, 4_096


@dataclass(frozen=True)
class Running:
    """One running value: ``fn`` is sum, max or last (last non-null)."""

    fn: str
    value: Column
    inclusive: bool = True


def _summary(spec: Running, order: Column) -> Column:
    if spec.fn == "sum":
        return F.sum(spec.value)
    if spec.fn == "max":
        return F.max(spec.value)
    return F.max_by(spec.value, F.when(spec.value.isNotNull(), order))


def _over(spec: Running, value: Column, window) -> Column:
    if spec.fn == "sum":
        return F.sum(value).over(window)
    if spec.fn == "max":
        return F.max(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def _combine(spec: Running, before: Column, local: Column) -> Column:
    if spec.fn == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
    if spec.fn == "max":
        return F.greatest(before, local)
    return F.coalesce(local, before)


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
            **specs: Running) -> DataFrame:
    """Add one column per spec. ``bucket`` must never fall as ``order`` rises.

    ``order`` must be total within a key. The number of buckets per key is what one task
    sees in the middle step, so it should be bounded or grow far slower than the rows.
    """
    # Keys as columns that are never null: the window and the plain join after it then ask for
    # one and the same partitioning, so the rows are shuffled once.
    whole = [f"_key{i}" for i in range(len(keys))]
    group = [*whole, *[f"_none{i}" for i in range(len(keys))], "_bucket", "_no_bucket"]
    base = df.withColumn("_at_bucket", bucket)
    named = {**{k: F.col(c) for k, c in zip(whole, keys)}, "_bucket": F.col("_at_bucket")}
    nulls = dict(zip([*whole, "_bucket"], [*group[len(keys):2 * len(keys)], "_no_bucket"]))
    types = dict(base.select(*[c.alias(k) for k, c in named.items()]).dtypes)
    base = base.withColumns({
        # A struct made of columns is never null itself.
        **{k: c if types[k].startswith("struct") else F.coalesce(c, _stand_in(types[k])) for k, c in named.items()},
        **{nulls[k]: c.isNull() for k, c in named.items()}}).drop("_at_bucket")
    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    summaries = base.groupBy(*group).agg(
        *[_summary(s, position).alias(n) for n, s in specs.items()]
    )
    earlier = Window.partitionBy(*group[:-2]).orderBy(F.col("_no_bucket").desc(), "_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = summaries.select(
        *group, *[_over(s, F.col(n), earlier).alias(f"_before_{n}") for n, s in specs.items()]
    )
    inside = Window.partitionBy(*group).orderBy(*order)
    local = base.withColumns({
        f"_local_{n}": _over(s, s.value, inside.rowsBetween(
            Window.unboundedPreceding, 0 if s.inclusive else -1))
        for n, s in specs.items()
    })
    joined = local.join(offsets, group)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_combine(s, F.col(f"_before_{n}"), F.col(f"_local_{n}")).alias(n)
          for n, s in specs.items()],
    )


def _stand_in(kind: str) -> Column:
    """A value of the type to stand for null; a flag beside it tells them apart."""
    if kind in ("string", "binary"):
        return F.lit("").cast(kind)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.lit("1970-01-01").cast(kind)
    if kind == "boolean":
        return F.lit(False)
    return F.lit(0).cast(kind)


def value_bucket(df: DataFrame, value: Column, rows: int = VALUE_ROWS) -> Column:
    """Bucket of a number by bounds taken from the data, so that rows spread whatever its range.

    The bounds are approximate quantiles of ``df``, as many as its rows call for. Equal values share
    a bucket and buckets rise with the value; nulls come first. A row finds its bucket by binary
    search. ``df`` is read twice, so it should be a written table.
    """
    wanted = min(VALUE_BUCKETS, -(-df.count() // rows))
    if wanted < 2:
        return F.lit(0)
    shares = F.array(*[F.lit(k / wanted) for k in range(1, wanted)])
    seen = df.agg(F.percentile_approx(value.cast("double"), shares, F.lit(10_000)).alias("b")).first()["b"]
    bounds = sorted({float(b) for b in seen or ()})
    table = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        F.get(table, at + s - 1) < value, at + s).otherwise(at))
    return F.when(value.isNull(), F.lit(-1)).otherwise(found)


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                name: str = "row_no") -> DataFrame:
    """1-based row number per key without a window over the whole key."""
    out = running(df, keys, bucket, order, **{name: Running("sum", F.lit(1).cast("bigint"))})
    return out.withColumn(name, F.col(name).cast("bigint"))


def hash_bucket(digest: Column, digits: int = 3) -> Column:
    """Order-preserving bucket of an md5 text: its first hex digits."""
    return F.substring(digest, 1, digits)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median per key (mean of the middle two for an even count) by exact ranks.

    Equal values are combined first, so the work per key is on distinct values.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counted, keys, value_bucket(counted, F.col(value)), [F.col(value)],
                     _hi=Running("sum", F.col("_c")))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    lower = F.floor((F.col("_size") + 1) / 2)
    upper = F.floor((F.col("_size") + 2) / 2)
    first = F.col("_hi") - F.col("_c") + 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= F.col("_hi")), F.col(value)))

    return (
        join_on(ranked, sizes, keys)
        .groupBy(*keys)
        .agg(((at(lower) + at(upper)) / 2).alias(name))
    )
