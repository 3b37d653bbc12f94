"""N-gram Jaccard join: links between texts whose shingle sets have a Jaccard similarity of 0.8.

1. Equal texts are one class, found by digest with a map-side combined aggregate.
2. Each class has its sorted shingle array, a parity bitmap (bit i: whether an odd number of
   shingles fall on i) and its prefix: the smallest fifth of its shingles plus one. Two sets of
   similarity 0.8 share a shingle of both prefixes.
3. Classes with an equal minhash are paired with the smallest of them. Verified pairs join most
   groups of copies before any tile is built.
4. Classes that share a prefix shingle and lie in the same or adjacent size bands form a tile.
   Tiles of one component are dropped, large ones are cut into pairs of blocks. Inside a block
   pair the Hamming distance of two bitmaps bounds the overlap from above:
   overlap <= (|x| + |y| - distance) / 2. A first pass pairs each class with its nearest partner
   of another component, a last one takes every pair of different components that the bound leaves.
5. Left pairs are verified by intersecting their sorted arrays.

Every link between different texts is either verified or joins two classes that verified links
have already connected, so components are exact.

Defined results: null, empty and blank texts have an empty set and link with nothing, also not
with each other; a row without id has no component (null) and links nothing; rows of the same
id are one node, with the links of all its texts; repeated rows are returned each; an empty
table gives no rows. Columns beyond (doc_id, text) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.components import components, relabelled
from boxloom.llm.shingles import mixed, shingle_set
from boxloom.session import drop_tables, durable

#: Similarity as a fraction, so that tests stay in whole numbers.
NUM, DEN = 80, 100
MINHASHES = 4
#: Ratio of a size band; above 1 / 0.8, so that partners lie at most one band apart.
BAND = 1.26
#: Rows of a tile's block.
BLOCK = 1024
#: Ids up to which a set of ids is broadcast (8 bytes each); beyond, it is joined by shuffle.
BROADCAST_IDS = 2_000_000

SKETCH = "doc_id bigint, n bigint, mins array<bigint>, bitmap binary, prefix array<bigint>, digest binary"


def least_overlap(a, b):
    """Smallest intersection of linked sets of sizes a and b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Parity bits over a power of two of places: one or more a shingle, four or more for small sets."""
    places = len(shingles) * (4 if len(shingles) <= 256 else 1)
    width = max(64, 1 << max(0, places - 1).bit_length())
    bits = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap (64-bit words) of a smaller power-of-two width."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(MINHASHES)]
    for batch in batches:
        sizes, mins, maps, prefixes = [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            n = len(s)
            sizes.append(n)
            mins.append([int(mixed(s ^ seed).min().astype(np.int64)) for seed in seeds] if n else [])
            maps.append(parity_bitmap(s) if n else b"")
            prefixes.append(s[:n - -(-NUM * n // DEN) + 1].view(np.int64) if n else np.zeros(0, np.int64))
        offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else []).cast(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(mins, pa.list_(pa.int64())),
             pa.array(maps, pa.binary()), prefix, batch.column(2)],
            names=["doc_id", "n", "mins", "bitmap", "prefix", "digest"])


def bounded_ids(ids: DataFrame) -> DataFrame:
    """Broadcast hint for ids whose number was counted and is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def overlap_bound(na, nb, distance):
    return (na + nb - distance) // 2


def may_link(na, nb, distance):
    return overlap_bound(na, nb, distance) >= least_overlap(na, nb)


def bitmap_passes(na: pd.Series, nb: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    out = []
    for a, b, p, q in zip(na, nb, x, y):
        p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        words = min(len(p), len(q))
        distance = int(np.bitwise_count(folded(p, words) ^ folded(q, words)).sum())
        out.append(bool(may_link(a, b, distance)))
    return pd.Series(out, dtype=bool)


def sets_link(x: pd.Series, y: pd.Series) -> pd.Series:
    out = []
    for p, q in zip(x, y):
        p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        if len(p) > len(q):
            p, q = q, p
        at = np.searchsorted(q, p)
        at[at == len(q)] = 0
        common = int((q[at] == p).sum()) if len(q) else 0
        out.append(common > 0 and DEN * common >= NUM * (len(p) + len(q) - common))
    return pd.Series(out, dtype=bool)


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())],
            names=["rep", "shingles"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of document ids whose shingle sets link."""
    pairs = durable(pairs.select("a", "b").distinct(), "pairs")
    needed = durable(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    sets = docs.select("doc_id", "text").join(bounded_ids(needed), "doc_id").mapInArrow(
        sets_of, "rep bigint, shingles binary")
    sets = durable(sets, "sets")
    linked = F.pandas_udf(sets_link, "boolean")
    links = durable(
        pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
        .where(linked("x", "y")).select("a", "b").distinct(), "links")
    drop_tables(sets, needed, pairs)
    return links


def minhash_pairs(classes: DataFrame) -> DataFrame:
    """Each class with the smallest class of the same minhash, if their bitmaps may link."""
    mins = classes.select("rep", "n", "bitmap", F.posexplode("mins").alias("k", "v"))
    centres = (mins.groupBy("k", "v").agg(F.min("rep").alias("a"), F.count("*").alias("size"))
               .where("size > 1").select("k", "v", "a"))
    # Checked against the bitmaps before any set is built.
    pairs = durable(mins.select("k", "v", "rep").join(centres, ["k", "v"]).where("a <> rep")
                    .select("a", F.col("rep").alias("b")).distinct(), "stars")
    maps = classes.select("rep", "n", "bitmap")
    passes = F.pandas_udf(bitmap_passes, "boolean")
    return (pairs.join(maps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("x")), "a")
            .join(maps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("y")), "b")
            .where(passes("na", "nb", "x", "y")).select("a", "b"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component of ``rep``; a class without links is its own."""
    named = labels.select(F.col("node").alias("rep"), "label")
    return rows.join(named, "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def mixed_only(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of those groups that hold more than one component, with the group's size as ``rows``."""
    spread = rows.groupBy(*keys).agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("rows"))
    return rows.join(spread.where("_low < _high").drop("_low", "_high"), keys)


def tiles(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, band, rep, n, guest, bitmap) of tiles with more than one component.

    Guests of a tile are the classes of the band below; they meet its own classes only. Of
    tiles with the same classes one is kept.
    """
    named = labelled(classes.select("rep", "n", "prefix"), labels)
    spread = named.select("label", F.explode("prefix").alias("key")).groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    # Only key and class of a row are shuffled by key; size and component come back to those that stay.
    shared = classes.select("rep", F.explode("prefix").alias("key")).join(spread, "key").join(named.drop("prefix"), "rep")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND)))
    placed = durable(shared.withColumn("band", band).select(
        "key", "rep", "n", "label", F.posexplode(F.array("band", F.col("band") + 1)).alias("guest", "band")), "shared")
    same = [F.bit_xor(F.xxhash64("rep", "guest")).alias("x"), F.sum(F.xxhash64("guest", "rep").cast("decimal(38,0)")).alias("s")]
    kept = (placed.groupBy("key", "band").agg(
                F.min("label").alias("low"), F.max("label").alias("high"), F.min("guest").alias("g"),
                F.count("*").alias("rows"), *same)
            .where("low < high AND g = 0").groupBy("band", "x", "s", "rows").agg(F.min("key").alias("key"))
            .select("key", "band"))
    rows = placed.join(kept, ["key", "band"]).select("key", "band", "rep", "n", "guest")
    out = durable(rows.join(classes.select("rep", "bitmap"), "rep"), "tiles")
    drop_tables(placed)
    return out


def small_unit_pairs(at: np.ndarray, sizes: np.ndarray, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of many small units at once, as far as sizes allow a link."""
    left, right = [], []
    for g in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(g, 1)
        base = at[sizes == g][:, None]
        x, y = (base + i).ravel(), (base + j).ravel()
        n, k = rows["n"], rows["label"]
        keep = (k[x] != k[y]) & ~((rows["guest"][x] == 1) & (rows["guest"][y] == 1))
        keep &= (rows["i"][x] == rows["j"][x]) | (rows["block"][x] != rows["block"][y])
        keep &= may_link(n[x], n[y], np.abs(n[x] - n[y]))
        left.append(x[keep])
        right.append(y[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def large_unit_pairs(unit: slice, rows: dict[str, np.ndarray], bitmaps: list[np.ndarray],
                     best_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one unit that the bitmap bound leaves: block against block."""
    at = np.arange(unit.start, unit.stop)
    n, label, guest, block, rep = (rows[c][unit] for c in ("n", "label", "guest", "block", "rep"))
    i, j = rows["i"][unit.start], rows["j"][unit.start]
    words = min(len(bitmaps[k]) for k in at)
    maps = np.stack([folded(bitmaps[k], words) for k in at])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b = [], []
    step = max(1, 2_000_000 // max(1, len(right) * words))
    for start in range(0, len(left), step):
        own = left[start:start + step]
        distance = np.bitwise_count(maps[own][:, None, :] ^ maps[right][None, :, :]).sum(axis=2, dtype=np.int64)
        keep = may_link(n[own][:, None], n[right][None, :], distance)
        keep &= label[own][:, None] != label[right][None, :]
        keep &= ~((guest[own] == 1)[:, None] & (guest[right] == 1)[None, :])
        if i == j:
            keep &= rep[own][:, None] < rep[right][None, :]
        x, y = np.nonzero(keep)
        if best_only and len(x):
            # For each row its nearest partner of another component.
            best = pd.DataFrame({"x": x, "y": y, "d": distance[x, y]})
            best = best.sort_values(["d", "y"]).drop_duplicates("x")
            x, y = best["x"].to_numpy(), best["y"].to_numpy()
        a.append(at[own[x]])
        b.append(at[right[y]])
    return (np.concatenate(a), np.concatenate(b)) if a else (at[:0], at[:0])


UNIT = ["key", "band", "i", "j"]
SMALL, CHUNK = 32, 20_000


def compare_units(best_only: bool):
    """Compares the rows of each unit; yields pairs of different components the bounds leave."""
    def pairs_of(found: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        rows = {c: found[c].to_numpy() for c in ("rep", "n", "label", "guest", "block", "i", "j")}
        bitmaps = [np.frombuffer(b, np.uint64) for b in found["bitmap"]]
        sizes = np.diff(np.append(starts, len(found)))
        small = sizes <= SMALL
        x, y = small_unit_pairs(starts[small], sizes[small], rows)
        pairs = pd.DataFrame({"a": rows["rep"][x], "b": rows["rep"][y], "x": x, "y": y}).drop_duplicates(["a", "b"])
        passed = []
        for p, q in zip(pairs["x"].tolist(), pairs["y"].tolist()):
            words = min(len(bitmaps[p]), len(bitmaps[q]))
            distance = int(np.bitwise_count(folded(bitmaps[p], words) ^ folded(bitmaps[q], words)).sum())
            passed.append(bool(may_link(rows["n"][p], rows["n"][q], distance)))
        out = [pairs.loc[np.array(passed, bool), ["a", "b"]]]
        for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
            x, y = large_unit_pairs(slice(start, start + size), rows, bitmaps, best_only)
            out.append(pd.DataFrame({"a": rows["rep"][x], "b": rows["rep"][y]}))
        every = pd.concat(out)
        low, high = np.minimum(every["a"], every["b"]), np.maximum(every["a"], every["b"])
        return pd.DataFrame({"a": low, "b": high}, dtype="int64").drop_duplicates()

    def first_rows(found: pd.DataFrame) -> np.ndarray:
        unit = found[UNIT].to_numpy()
        return np.concatenate(([0], np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:  # rows are sorted by unit; the last unit may go on in the next batch
            held.append(batch)
            size += len(batch)
            if size >= CHUNK:
                found = pd.concat(held, ignore_index=True)
                starts = first_rows(found)
                if len(starts) > 1:
                    yield pairs_of(found.iloc[:starts[-1]], starts[:-1])
                held = [found.iloc[starts[-1]:].reset_index(drop=True)]
                size = len(held[0])
        if size:
            found = pd.concat(held, ignore_index=True)
            yield pairs_of(found, first_rows(found))

    return compare


def tile_pairs(rows: DataFrame, labels: DataFrame, best_only: bool) -> DataFrame:
    """Candidate pairs of all tiles that still hold more than one component."""
    left = mixed_only(labelled(rows, labels), ["key", "band"])
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    cut = left.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    units = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "rep", "n", "label", "block", "guest", "bitmap")
    return units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInPandas(compare_units(best_only), "a bigint, b bigint")


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sketches(docs: DataFrame) -> DataFrame:
    """(rep, n, mins, bitmap, prefix, digest): one row per text, and those of rows without id (rep null).

    Texts are sketched where they lie; only sketches are shuffled, and of these the one of the
    smallest id of each text stays.
    """
    rows = docs.select("doc_id", "text", text_digest(F.col("text")).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("least", F.lit(True))
    once = rows.mapInArrow(sketch, SKETCH).groupBy("doc_id", "digest").agg(
        *[F.first(c).alias(c) for c in ("n", "mins", "bitmap", "prefix")])
    return durable(once.join(first, ["doc_id", "digest"], "left").where("least OR doc_id IS NULL").select(
        F.col("doc_id").alias("rep"), "n", "mins", "bitmap", "prefix", "digest"), "sketches")


def link_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select("doc_id", "text")
    keyed = docs.select("doc_id", text_digest(F.col("text")).alias("digest"))
    sketched = sketches(docs)
    classes = sketched.where("rep IS NOT NULL AND n > 0")

    links = verified(minhash_pairs(classes), docs)
    labels = components(links)
    drop_tables(links)
    rows = tiles(classes, labels)
    for best_only in (True, False):
        links = verified(tile_pairs(rows, labels, best_only), docs)
        labels = relabelled(labels, links)
        drop_tables(links)
    drop_tables(rows)

    named = labels.select(F.col("node").alias("rep"), "label")
    texts = sketched.groupBy("digest").agg(F.min("rep").alias("rep"), F.max("n").alias("n_shingles"))
    of_class = durable(texts.join(named, "rep", "left").select(
        "digest", "rep", "n_shingles", F.coalesce("label", "rep").alias("label")), "classes")
    drop_tables(sketched, labels)
    out = keyed.join(of_class, "digest")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select("doc_id", "n_shingles", F.when(linked, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row for each group of linked documents: the smallest id's. Rows without id stay."""
    linked = link_documents(docs)
    dropped = durable(linked.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    kept = docs.join(bounded_ids(dropped), "doc_id", "left_anti").select(*docs.columns)
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(kept.where("doc_id IS NULL"))
