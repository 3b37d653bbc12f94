"""Assignment of images to splits, of classes to boxes and of files to classes."""

from __future__ import annotations

from functools import reduce
from math import lcm

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions.names import canonical_name, digest, digest_number, image_file_name
from boxloom.operators.seats import SeatIndex, with_seats
from boxloom.plans.running import Running, hash_bucket, number_rows, running
from boxloom.plans.skew import join_on
from boxloom.session import SPLITS, durable

# Target shares of the splits and the turns an image may take.
SPLIT_SHARES = {"train": 0.7, "valid": 0.2, "test": 0.1}
SPLIT_WEIGHTS = {"train": 7, "valid": 2, "test": 1}
ANGLES = (0, 90, 180, 270)

_SEATS_PER_STEP = 10_000
#: Classes of all splits whose quotas are sent to every task; their index takes about 100 MB.
MOST_SEAT_CLASSES = 1_000_000


def split_files(files: DataFrame, name: str, seed: str,
                shares: dict[str, float] = SPLIT_SHARES) -> DataFrame:
    """Every file in exactly one split: random order, sizes cut to whole numbers, rest last.

    The order is that of seeded md5 texts. Ranks come from sorted hash buckets with known
    offsets, never from one global sort window.
    """
    n = files.count()
    ranked = number_rows(
        files.withColumn("_d", digest(seed, F.col(name))), [], hash_bucket(F.col("_d"), 4),
        [F.col("_d"), F.col(name)], "_n").drop("_d")
    splits = list(shares)
    ends, total = [], 0
    for s in splits[:-1]:
        total += int(shares[s] * n)
        ends.append((s, total))
    chosen = reduce(lambda c, e: c.when(F.col("_n") <= e[1], e[0]), ends[1:],
                    F.when(F.col("_n") <= ends[0][1], ends[0][0]))
    return ranked.withColumn("split", chosen.otherwise(splits[-1])).drop("_n")


def split_quota(spark: SparkSession, n_images: int, counts: dict[str, int],
                available: tuple[str, ...] = SPLITS,
                weights: dict[str, int] = SPLIT_WEIGHTS) -> DataFrame:
    """(image_no, split) for new images, each going to the split least filled for its weight.

    The k-th image of a split is due at k divided by its weight. Its place among all
    splits follows by counting, for every other split, the images due before it, so each
    row is computed alone: no loop, sort or shuffle. Splits without templates get none.
    """
    open_splits = [s for s in weights if s in available]
    step = {s: lcm(*weights.values()) // weights[s] for s in open_splits}
    parts = []
    for i, s in enumerate(open_splits):
        k = F.col("id") + counts.get(s, 0)
        due = k * step[s]
        place = F.col("id")
        for j, other in enumerate(open_splits):
            if other == s:
                continue
            before = F.floor(due / step[other]) + 1 if j < i else F.ceil(due / step[other])
            place = place + F.greatest(F.lit(0), before - counts.get(other, 0))
        parts.append(
            spark.range(n_images).select(place.cast("bigint").alias("image_no"), F.lit(s).alias("split"))
            .filter(F.col("image_no") < n_images))
    if not parts:
        return spark.createDataFrame([], "image_no bigint, split string")
    return reduce(DataFrame.unionByName, parts)


def template_pairs(images: DataFrame, label_files: DataFrame) -> DataFrame:
    """Images (split, stem) that have a label file of the same stem in the same split."""
    return images.join(label_files.select("split", "stem").distinct(), ["split", "stem"], "left_semi")


def carry_labels(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Assigned images (stem, split) with their labels; images without labels stay.

    Images with labels come by an inner join, whose skewed side the engine may split; an
    outer join could not split an image with very many labels. That join is written, so label
    files are read and parsed once; the stems it holds tell which images are without labels.
    """
    met = durable(join_on(assigned, labels, ["stem"]), "carried-labels")
    bare = join_on(assigned, met.select("stem").distinct(), ["stem"], "left_anti")
    return met.unionByName(bare, allowMissingColumns=True)


def pending_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted files that are not present yet."""
    return wanted.join(present.select("file"), "file", "left_anti")


def present_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted files that are already there; they count towards the total."""
    return wanted.join(present.select("file"), "file", "left_semi")


def first_usable_printing(printings: DataFrame, set_id: str, usable: Column | None = None) -> DataFrame:
    """Per card the first printing of a set that has a URL (and passes ``usable``)."""
    ok = (F.col("set_id") == set_id.upper()) & (F.coalesce("image_url", F.lit("")) != "")
    if usable is not None:
        ok = ok & usable
    return printings.filter(ok).groupBy("card_no").agg(
        F.min(F.struct("pos", "id", "image_url", "name")).alias("_p")).select(
        "card_no", "_p.*")


def download_list(printings: DataFrame, set_id: str, present: DataFrame) -> DataFrame:
    """(card_no, name, id, image_url, file) of the card images of a set that have to be fetched.

    A card needs one image: that of its first printing in the set that has a URL. Where the file of
    that printing is ``present`` (file), the card is done.
    """
    first = first_usable_printing(printings, set_id)
    wanted = first.select("card_no", "name", "id", "image_url", image_file_name(F.col("name"), F.col("id")).alias("file"))
    return pending_files(wanted, present)


def class_files(files: DataFrame, seed: str) -> DataFrame:
    """Files (set_code, file) of each class, numbered from 0 in seeded order, with their count.

    Long form in place of a list per class, so that a class may have any number of files;
    a draw is an equi-join on class and number.
    """
    stem = F.regexp_extract("file", r"^(?s)(.*)\.[^.]*$", 1)
    named = files.filter(F.lower("file").endswith(".png")).select(
        canonical_name(stem).alias("name"), "set_code", "file",
        digest(seed, F.col("set_code"), F.col("file")).alias("_d"))
    numbered = number_rows(named, ["name"], hash_bucket(F.col("_d"), 2),
                           [F.col("_d"), F.col("set_code"), F.col("file")], "_n")
    sizes = named.groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    return numbered.join(sizes, "name").select(
        "name", (F.col("_n") - 1).alias("file_no"), "set_code", "file", "files")


def draw(rows: DataFrame, pool: DataFrame, keys: list[str], number: str, size: str,
         seed: str, by: list[str], sizes: DataFrame | None = None, on_miss: str = "keep") -> DataFrame:
    """One numbered pool row per input row, picked by a seeded hash of the ``by`` columns.

    A row whose keys have no pool is kept with nulls, left out (``"drop"``), or fails the job
    (``"fail"``).
    """
    if on_miss not in ("keep", "drop", "fail"):
        raise ValueError(f"unknown on_miss {on_miss}")
    if sizes is None:
        sizes = pool.select(*keys, size).distinct()
    at = digest_number(digest(seed, *[F.col(c) for c in by])) % F.col(size)
    how = "inner" if on_miss == "drop" else "left"
    placed = join_on(rows, sizes, keys, how).withColumn(number, at).drop(size)
    if on_miss == "fail":
        said = F.concat(F.lit("nothing to draw from for "), F.to_json(F.struct(*keys)))
        placed = placed.withColumn(number, F.when(F.col(number).isNull(), F.raise_error(said).cast("bigint")).otherwise(F.col(number)))
    return join_on(placed, pool.drop(size) if size in pool.columns else pool, [*keys, number], how)


def fallback_splits(quota: DataFrame, templates: DataFrame) -> DataFrame:
    """``quota`` (image_no, split), where a split without templates gives way to the first that has some."""
    having = {r["split"] for r in templates.select("split").distinct().collect()}
    ready = [s for s in SPLITS if s in having]
    if not ready:
        raise ValueError("no split has a template")
    return quota.withColumn("split", F.when(F.col("split").isin(ready), F.col("split")).otherwise(ready[0]))


def numbered_files(files: DataFrame, seed: str) -> DataFrame:
    """``class_files`` with ``no``, the number of a file among all: its class's offset plus its own.

    Only classes are run over to get the offsets.
    """
    pool = class_files(files, seed)
    sizes = pool.groupBy("name").agg(F.max("files").alias("files"))
    offsets = running(sizes, [], F.substring("name", 1, 2), [F.col("name")],
                      _first=Running("sum", F.col("files"), inclusive=False)).select("name", "_first")
    return pool.join(offsets, "name").select("name", "set_code", "file", (F.col("_first") + F.col("file_no")).alias("no"))


def draw_files(rows: DataFrame, files: DataFrame, seed: str, by: list[str]) -> DataFrame:
    """``rows`` with one of all card files each (name, set_code, file), every file as likely as another."""
    pool = durable(numbered_files(files, seed), "card-files")
    total = pool.count()
    if not total:
        raise ValueError("no card files to draw from")
    at = digest_number(digest(f"{seed}-file", *[F.col(c) for c in by])) % total
    return rows.withColumn("no", at).join(pool, "no").drop("no")


def pick_one(rows: DataFrame, keys: list[str], seed: str, by: list[str]) -> DataFrame:
    """One row per key, picked by a seeded hash (combined map-side)."""
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(digest(seed, *[F.col(c) for c in by]), *[F.col(c) for c in by])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*")


def turn(seed: str, image_no: Column) -> Column:
    """Seeded quarter turn of an image."""
    return F.element_at(F.array(*[F.lit(a) for a in ANGLES]),
                        (digest_number(digest(seed, image_no)) % len(ANGLES) + 1).cast("int"))


def lowest_classes(counts: DataFrame, split: str, k: int, below: int | None = None) -> DataFrame:
    """The ``k`` classes of a split with the fewest labels (fewest in total first on a tie)."""
    rows = counts.filter(F.col("split") == split)
    if below is not None:
        rows = rows.filter(F.col("n") < below)
    return rows.orderBy("n", "total", "class_id").limit(k)


def _log_bucket(c: Column) -> Column:
    return F.floor(F.log2(c + 1))


def class_quota(counts: DataFrame, slots: DataFrame, seed: str) -> DataFrame:
    """How many of a split's slots each class gets so that the lowest counts rise first.

    ``counts``: split, class_id, n, total. ``slots``: split, slots. Filling the lowest
    class again and again ends with all filled classes level. The level follows from
    running sums over sorted counts; what is left over goes to the classes with the
    fewest labels in total, ties by seeded hash. Both tables are as small as the registry
    and are written once, since the level and the quotas each read them again.
    """
    counts = durable(counts, "counts")
    ran = running(
        counts, ["split"], _log_bucket(F.col("n")), [F.col("n"), F.col("class_id")],
        _i=Running("sum", F.lit(1).cast("bigint")), _s=Running("sum", F.col("n")))
    reach = ran.join(slots, "split").filter(F.col("_i") * F.col("n") - F.col("_s") <= F.col("slots"))
    levels = reach.groupBy("split").agg(F.max(F.struct("_i", "_s", "n", "slots")).alias("_m"))
    spare = F.col("_m.slots") - (F.col("_m._i") * F.col("_m.n") - F.col("_m._s"))
    levels = levels.select(
        "split", (F.col("_m.n") + F.floor(spare / F.col("_m._i"))).alias("_level"),
        (spare % F.col("_m._i")).alias("_extra"))
    filled = join_on(counts, levels, ["split"]).filter(F.col("n") <= F.col("_level")).withColumn(
        "_d", digest(seed, F.col("split"), F.col("class_id")))
    ranked = number_rows(filled, ["split"], _log_bucket(F.col("total")),
                         [F.col("total"), F.col("_d"), F.col("class_id")], "_r")
    quota = F.col("_level") - F.col("n") + F.when(F.col("_r") <= F.col("_extra"), 1).otherwise(0)
    return durable(ranked.withColumn("quota", quota.cast("bigint")).filter(F.col("quota") > 0).select(
        "split", "class_id", "n", "total", "quota"), "quotas")


def _seats_by_sort(quotas: DataFrame, seed: str) -> DataFrame:
    """One row per slot of any quotas: (split, slot_no, class_id, level), sorted by need.

    Large quotas are expanded in two steps, so no row unfolds into one huge array.
    """
    blocks = quotas.withColumn("_k", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / _SEATS_PER_STEP))))
    first = F.col("_k") * _SEATS_PER_STEP
    seats = blocks.withColumn("_j", F.explode(F.sequence(
        first, F.least(first + _SEATS_PER_STEP, F.col("quota")) - 1))).select(
        "split", "class_id", "total", (F.col("n") + F.col("_j")).alias("level"),
        digest(seed, F.col("split"), F.col("class_id")).alias("_d"))
    numbered = number_rows(
        seats, ["split"], F.floor(F.col("level") / 16),
        [F.col("level"), F.col("total"), F.col("_d"), F.col("class_id")], "_n")
    return numbered.select("split", (F.col("_n") - 1).alias("slot_no"), "class_id", "level")


def seat_index(quotas: DataFrame, seed: str) -> dict[str, SeatIndex] | None:
    """Seats of each split by number; None for a registry too large to send to every task, or for
    quotas that do not fill to one level."""
    if quotas.limit(MOST_SEAT_CLASSES + 1).count() > MOST_SEAT_CLASSES:
        return None
    ranked = quotas.withColumn("_d", digest(seed, F.col("split"), F.col("class_id"))).orderBy("split", "total", "_d", "class_id")
    found = ranked.select("split", "class_id", "n", "quota").toPandas()
    try:
        return {split: SeatIndex(*(g[c].to_numpy(np.int64) for c in ("class_id", "n", "quota"))) for split, g in found.groupby("split")}
    except ValueError:
        return None


def seated(slots: DataFrame, quotas: DataFrame, seed: str, makeup_min: int = 0) -> DataFrame:
    """``slots`` (split, slot_no, ...) with the class, level and makeup mark of their seat.

    The class follows from the slot's number (see ``seats``), without a table of seats.
    """
    index = seat_index(quotas, seed)
    if index is not None:
        return with_seats(slots, index, makeup_min)
    seats = _seats_by_sort(quotas, seed).withColumn("makeup", F.col("level") < makeup_min)
    return slots.join(seats, ["split", "slot_no"])


def class_seats(quotas: DataFrame, seed: str, makeup_min: int = 0) -> DataFrame:
    """One row per slot: (split, slot_no, class_id, level, makeup), lowest counts first, slots from 0.

    ``makeup`` marks slots that lift a class towards ``makeup_min``; these come first by
    themselves since slots rise by count.
    """
    quotas = durable(quotas, "quotas")
    sizes = {r["split"]: r["n"] for r in quotas.groupBy("split").agg(F.sum("quota").alias("n")).collect()}
    slots = reduce(DataFrame.union, [
        quotas.sparkSession.range(n).select(F.lit(split).alias("split"), F.col("id").alias("slot_no"))
        for split, n in sorted(sizes.items())], quotas.sparkSession.createDataFrame([], "split string, slot_no bigint"))
    return seated(slots, quotas, seed, makeup_min)
