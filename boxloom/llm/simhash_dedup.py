"""SimHash near-duplicates: fingerprints that differ in at most two of 64 bits, by deletion variants.

1. Each text gets its fingerprint once. Documents of one fingerprint are one class (combined
   map-side), so copies never meet each other.
2. A fingerprint is cut into two halves, one fewer than three exact pieces would need: of two
   linked fingerprints, one half differs by at most one bit. Each half is indexed whole and in
   its 32 variants with one bit wildcarded; halves that differ in exactly that bit share the
   variant.
3. Keys are counted (combined map-side); only those stay that hold both values of the wildcarded
   bit, or two fingerprints of an equal half.
4. Members of a key join on it, and the number of differing bits decides. A key with more than
   ``PAIR_LIMIT`` members makes no pairs: its members meet again on the other half with as many
   bits deleted as the budget leaves, where each group is small by construction (at most 529
   distinct values lie within two deleted bits) and linked to one centre, so the work stays in
   proportion to its members.
5. Links are closed to components in rounds of joins over written tables.

All links are found: either both ways of a half differing by at most one bit are compared, or
they are connected through the centre, which lies within two bits of each. Components are exact.

Defined results: null, empty and blank texts have fingerprint zero and link like any other. A row
without id links by its fingerprint and gets the smallest id of its component, null if there is
none. Rows of one id are kept each, each with the component of its own text. An empty table gives
no rows. Columns beyond (doc_id, text) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.arrow import slices
from boxloom.llm.components import components
from boxloom.llm.jaccard_join import bounded_ids
from boxloom.session import durable

# Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE = 3
SEED = 42
BITS = 2

HALF = 32
#: Variants of a half: one for each wildcarded bit, and the half itself.
VARIANTS = HALF + 1
#: Members up to which a key is joined with itself; chance alone puts about this many of
#: 10^11 fingerprints under one key.
PAIR_LIMIT = 64
#: Shingles of a long text that are hashed at a time.
CHUNK = 8_192


def shingle_hashes(words: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in chunks; fewer words are one shingle."""
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)
        return
    count = len(words) - SHINGLE + 1
    for at in range(0, count, CHUNK):
        part = words[at:at + CHUNK + SHINGLE - 1]
        joined = map(b" ".join, zip(*[part[k:] for k in range(SHINGLE)]))
        yield np.fromiter((digest(s, SEED) for s in joined), np.uint64, len(part) - SHINGLE + 1)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint, as a signed number: a bit is 1 if set in over half the hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(words):
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(fingerprint, batch.column(1).to_pylist()), pa.int64())],
                names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def half(fp: Column, upper: Column) -> Column:
    low = F.lit((1 << HALF) - 1)
    return F.when(upper, F.shiftrightunsigned(fp, HALF)).otherwise(fp).bitwiseAND(low)


def variants(prints: DataFrame) -> DataFrame:
    """Each fingerprint under its whole and one-wildcard halves: (key, wild, bit, fp).

    The key holds the half's number, the wildcarded place (32 for none) and the other bits.
    """
    kind = F.col("kind")
    bit = F.expr(f"shiftleft(1L, kind % {VARIANTS})")
    wild = kind % VARIANTS < HALF
    rows = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * VARIANTS - 1))).alias("kind"))
    own = half(F.col("fp"), kind >= VARIANTS)
    kept = F.when(wild, own.bitwiseAND(F.bitwise_not(bit))).otherwise(own)
    return rows.select(
        F.shiftleft(kind.cast("bigint"), HALF).bitwiseOR(kept).alias("key"), wild.alias("wild"),
        (wild & (own.bitwiseAND(bit) != 0)).cast("int").alias("bit"), "fp")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Keys under which fingerprints may link, with their number of members."""
    ones = F.sum("bit")
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), ones.alias("ones"), F.first("wild").alias("wild"))
    return counted.where("n > 1 AND (NOT wild OR (ones > 0 AND ones < n))").select("key", "n")


def pair_links(members: DataFrame) -> DataFrame:
    """Links between members of keys that are small enough to be joined with themselves."""
    one, other = (members.select("key", F.col("fp").alias(c)) for c in "ab")
    return one.join(other, "key").where((F.col("a") < F.col("b")) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b")


def star_links(members: DataFrame) -> DataFrame:
    """Links among members of large keys, each to the centre of a group on the other half.

    Under a wildcard the other halves may differ by one bit, under an equal half by two. A member
    comes with the other half as it is, and with one (or up to two) of its set bits deleted. Those
    that come undeleted lie within the budget of all others of the group; those with one deletion
    lie within two of each other.
    """
    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_024):
            keys, wild = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            prints = batch.column(2).to_numpy()
            upper = (keys >> HALF) >= VARIANTS
            rest = np.where(upper, prints, prints >> HALF) & ((1 << HALF) - 1)
            levels = [(np.arange(len(keys)), rest)]
            places = 1 << np.arange(HALF, dtype=np.int64)
            row, place = np.nonzero(rest[:, None] & places)
            levels.append((row, rest[row] & ~places[place]))
            left = levels[1][1][:, None] & np.where(places < places[place][:, None], places, 0)
            left[wild[row]] = 0  # a wildcard has used one of the two bits
            again, second = np.nonzero(left)
            levels.append((row[again], levels[1][1][again] & ~places[second]))
            for deletions, (of, value) in enumerate(levels):
                if len(of):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[of]), pa.array(value), pa.array(np.full(len(of), deletions, np.int32)), pa.array(prints[of]),
                         pa.array(wild[of])], names=["key", "rest", "deletions", "fp", "wild"])

    rows = members.select("key", "wild", "fp").mapInArrow(deleted, "key bigint, rest bigint, deletions int, fp bigint, wild boolean")
    groups = rows.groupBy("key", "rest").agg(
        F.min(F.when(F.col("deletions") == 0, F.col("fp"))).alias("whole"),
        F.min(F.when(~F.col("wild") & (F.col("deletions") == 1), F.col("fp"))).alias("once"),
        F.collect_list(F.struct("deletions", "fp")).alias("all")).where(F.size("all") > 1)
    links = groups.select("whole", "once", F.explode("all").alias("m")).select(
        F.explode(F.array(
            F.struct(F.col("whole").alias("a"), F.col("m.fp").alias("b")),
            F.struct(F.when(F.col("m.deletions") == 1, F.col("once")).alias("a"), F.col("m.fp").alias("b")))).alias("l"))
    return links.select("l.a", "l.b").where("a IS NOT NULL AND a <> b")


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints of ``prints`` (fp), enough to connect all that link."""
    rows = variants(prints)
    shared = durable(shared_keys(rows), "shared-keys")
    members = durable(rows.join(bounded_ids(shared), "key").select("key", "wild", "n", "fp"), "members")
    small = pair_links(members.where(F.col("n") <= PAIR_LIMIT))
    large = members.where(F.col("n") > PAIR_LIMIT)
    if large.isEmpty():
        return small
    return small.union(star_links(large))


def link_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = durable(fingerprints(docs), "fingerprints")
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    labels = components(near_links(classes.select("fp")))
    of_print = classes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), "rep")
    named = of_print.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = durable(of_print.join(named, "label").select("fp", "component_id"), "classes")
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
