"""Filter interaction audit: what each filter does in every order of all five.

1. Each text is tested once by all five filters. A document then becomes a 32-bit survival word:
   bit s tells whether it survives the subset s of filters (bit i of s is the i-th filter).
2. Words are added up per part and label by positional popcounts with carry-save adders: three
   words become one word of sums and one of carries, until few words of each weight are left.
   So the survivors of all 32 subsets come from one pass.
3. Everything reported, the Shapley sums too, follows from subset survivors: the documents a
   filter removes after a set of others are survivors of the set less those of the larger set.

Only the counts (parts x 3 labels x 32 subsets) are shuffled by part, combined map-side. The test
for repeated texts takes the smallest id per text digest (combined map-side) and joins it back on
id and digest, so a text with very many copies meets no task alone.

Defined results: a null text is empty; a null language is the part ''. A row without id has no
smaller id and is no smaller id, so it never counts as repeated, and it has no label. Rows of one
id are counted each; an equal row of the same id is no smaller id. Several labels of an id: one
that says 1 is enough. No documents, no rows. Columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.arrow import slices
from boxloom.session import durable

# Fixed values of the five filters.
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
MARKS = b"#$%&*|"

SUBSETS = 1 << len(FILTERS)
KINDS = ("all", "good", "toxic")
#: Parts whose counts a task holds before it sends them on.
HELD_PARTS = 1_000

_NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Survival word by failure mask.
SURVIVAL = np.array(
    [sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text (UTF-8) fails."""
    words = text.split()
    capitals = len(text.translate(None, _NOT_CAPITALS))
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _CONTINUATION)))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3)


def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or b"" for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(map(failures, texts), pa.int32()),
             pa.array(map(xxhash.xxh3_128_digest, texts), pa.binary())],
            names=["doc_id", "part", "failed", "digest"])


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by carry-save addition."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) >= 3:
            third = len(words) // 3
            a, b, c = words[:third], words[third:2 * third], words[2 * third:3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third:]])
        counts += weight * ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part and kind the survivors of each subset, from rows (part, failed, good, toxic)."""
    held: dict[str, np.ndarray] = {}

    def sent() -> pa.RecordBatch:
        parts, counts = list(held), np.stack(list(held.values()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(parts, len(KINDS) * SUBSETS).tolist(), pa.string()),
             pa.array(np.tile(np.arange(len(KINDS) * SUBSETS, dtype=np.int32), len(parts))),
             pa.array(counts.ravel())], names=["part", "at", "n"])

    for batch in batches:
        named = batch.column(0).dictionary_encode()
        of_row = named.indices.to_numpy(zero_copy_only=False)
        words = SURVIVAL[batch.column(1).to_numpy(zero_copy_only=False)]
        flags = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
        order = np.argsort(of_row, kind="stable")
        ends = np.cumsum(np.bincount(of_row, minlength=len(named.dictionary)))
        for part, rows in zip(named.dictionary.to_pylist(), np.split(order, ends[:-1])):
            counted = np.stack([positional_popcount(words[rows]),
                                *[positional_popcount(words[rows[flag[rows]]]) for flag in flags]])
            held[part] = held[part] + counted if part in held else counted
        if len(held) > HELD_PARTS:
            yield sent()
            held.clear()
    if held:
        yield sent()


#: Each order of the filters, with the subset before each of its steps and the filter's bit.
ORDERS = [("".join(FILTERS[f] for f in order), [(sum(1 << f for f in order[:k]), 1 << order[k]) for k in range(len(order))])
          for order in permutations(range(len(FILTERS)))]

REPORT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
          "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def shapley_sum(n: np.ndarray, bit: int) -> int:
    """Documents the filter removes, summed over all orders: each set before it comes in
    (its size)! x (the rest's size)! of them."""
    others = len(FILTERS) - 1
    return sum(factorial(s.bit_count()) * factorial(others - s.bit_count()) * int(n[s] - n[s | bit])
               for s in range(SUBSETS) if not s & bit)


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part from its counts (96 numbers)."""
    names = [c.split()[0] for c in REPORT.split(", ")]
    every = SUBSETS - 1
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, good, toxic = np.array(counts, np.int64).reshape(len(KINDS), SUBSETS)
            shapley = {1 << f: shapley_sum(n, 1 << f) for f in range(len(FILTERS))}
            rows = []
            for order, steps in ORDERS:
                for step, (before, bit) in enumerate(steps, 1):
                    after = before | bit
                    removed = int(n[before] - n[after])
                    rows.append((
                        part, order, step, int(n[after]), removed, int(n[0] - n[bit]) - removed,
                        int(n[every & ~bit] - n[every]), int(good[before] - good[after]),
                        int(toxic[before] - toxic[after]), shapley[bit]))
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(names) - 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of filters and step, from (doc_id, text, lang) and (doc_id, quality, toxic)."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    rows = durable(rows.mapInArrow(tested, "doc_id bigint, part string, failed int, digest binary"), "tested")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    says = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    marked = rows.join(firsts, ["doc_id", "digest"], "left").join(says, "doc_id", "left").select(
        "part", (F.col("failed") + F.when(repeated, 16).otherwise(0)).alias("failed"),
        F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    counts = marked.mapInArrow(survivors, "part string, at int, n bigint").groupBy("part", "at").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "n")))["n"].alias("counts"))
    return whole.mapInArrow(report, REPORT)
