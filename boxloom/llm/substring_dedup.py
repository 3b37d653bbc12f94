"""Substring dedup: repeated lines and sentences across all documents.

A text is cut into units that tile it: lines, cut further where a sentence ends. A unit is
normalised (A-Z lower-cased, white space runs as one space) and hashed to 128 bits. A unit of
fewer than ``LEAST_WORDS`` words is hashed with the units that follow it, as many as it takes,
so a short phrase counts as repeated only where its continuation repeats too. At the end of a text
the units before it make up what is missing, with its place counted from the end; a text of fewer
words repeats only as a whole.

Units of equal digest are one group over all documents. The occurrence of the lowest rank
(doc_id, then offset, then copy of the row) is kept; every other one is removed. Counting is combined before the
shuffle, and only units whose digest occurs again are joined back.

Defined results: null, empty and blank texts have no units; a repetition inside one document
counts like one across documents; of equal rows one is kept and the units of the others are
repetitions; a null id ranks after all others; offsets are code points of the original text, ends exclusive;
columns beyond (doc_id, text) are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.session import durable

LEAST_WORDS = 8
#: Where a unit ends: behind a line feed, or behind sentence marks and the white space they need.
END = re.compile(r"\n|[.!?。！？]+[^\S\n]+\n?|[.!?。！？]+\n")
UNITS = "doc_id bigint, row bigint, start int, end int, n_words int, high bigint, low bigint"


def units_of(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, own words, digest) of every unit."""
    ends = [m.end() for m in END.finditer(text)]
    spans, words, at = [], [], 0
    for end in [*ends, len(text)]:
        own = text[at:end].encode("utf-8", "surrogatepass").lower().split()
        if own:
            spans.append((at, end))
            words.append(own)
        at = end
    out = []
    for i, ((a, b), own) in enumerate(zip(spans, words)):
        key, k = own, i
        while len(key) < LEAST_WORDS and k + 1 < len(words):
            k += 1
            key = key + words[k]
        short = len(own) < LEAST_WORDS
        seed, j = len(own) if short else 0, i
        if len(key) < LEAST_WORDS:  # few words are left: where the unit stands before the end
            seed += LEAST_WORDS * len(key)
        while len(key) < LEAST_WORDS and j:
            j -= 1
            key = words[j] + key
        # The seed, how much of the key is the unit's own and where, keeps units of one key apart.
        out.append((a, b, len(own), xxhash.xxh3_128_digest(b" ".join(key), seed=seed)))
    return out


def list_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [units_of(t.as_py() or "") for t in batch.column(1)]
        sizes = list(map(len, found))
        flat = [u for units in found for u in units]
        digests = np.frombuffer(b"".join(u[3] for u in flat), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k).take(pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64())) for k in (0, 2)],
             *[pa.array([u[k] for u in flat], pa.int32()) for k in range(3)],
             pa.array(digests[:, 0]), pa.array(digests[:, 1])],
            names=["doc_id", "row", "start", "end", "n_words", "high", "low"])


def repeats_of(numbered: DataFrame) -> DataFrame:
    """Removed spans of ``numbered`` (doc_id, text, row), with their row."""
    units = durable(numbered.select("doc_id", "text", "row").mapInArrow(list_units, UNITS), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("start"), F.col("row"))
    again = durable(
        units.groupBy("high", "low").agg(F.min(rank).alias("kept"), F.max(rank).alias("last"))
        .where("kept < last").select("high", "low", "kept"), "repeated")
    return (units.join(again, ["high", "low"]).where(rank > F.col("kept"))
            .select("doc_id", "row", "start", "end", "n_words", F.col("kept.doc_id").alias("kept_doc_id"),
                    F.col("kept.start").alias("kept_start")))


def repeats(docs: DataFrame) -> DataFrame:
    """Removed spans: (doc_id, start, end, n_words, kept_doc_id, kept_start).

    Rows are numbered as the units are written, so copies of a row stay apart; which copy is kept
    does not show in the result.
    """
    return repeats_of(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())).drop("row")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its repeated units cut out of ``text``; rows are numbered in a written table."""
    docs = durable(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    spans = (repeats_of(docs.select("doc_id", "text", F.col("_row").alias("row"))).groupBy("row")
             .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_cut")))
    joined = docs.join(spans, docs["_row"] == spans["row"], "left").drop(spans["row"], docs["_row"])

    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, found):
            if text is not None and spans is not None:
                parts, at = [], 0
                for s in spans:
                    parts.append(text[at:s["start"]])
                    at = s["end"]
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return joined.withColumn("text", F.pandas_udf(cut, "string")("text", "_cut")).drop("_cut")
