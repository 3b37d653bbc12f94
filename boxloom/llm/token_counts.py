"""Token counts of sections: whole texts are encoded once, tokens are attributed by offset.

Sections are the lines of a text, each with its line feed, so they tile the text. A token's
span covers every character it has a byte of. It counts for the section that holds most of its
characters, at a tie for the earlier one; tokens that reach into several sections are also
counted apart. Counts of all sections of a text add up to its tokens.

Defined results: a null or empty text has one empty section without tokens; a text that ends
with a line feed has no empty section after it; repeated rows are counted each; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxloom.llm.arrow import slices
from boxloom.llm.byte_bpe import encoded

SECTIONS = "doc_id bigint, section int, start int, end int, n_tokens bigint, n_crossing bigint"


def line_starts(text: str) -> np.ndarray:
    """Offsets at which lines start; the first is 0."""
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def attribute(bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a section's end. ``bounds``: section starts."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    owner = first.copy()
    crossing = first != last
    for t in np.flatnonzero(crossing).tolist():
        edges = np.concatenate(([starts[t]], bounds[first[t] + 1:last[t] + 1], [ends[t]]))
        owner[t] = first[t] + int(np.argmax(np.diff(edges)))  # the first of equal ones
    return owner, crossing


def section_tokens(docs: DataFrame, path: str) -> DataFrame:
    """One row per section of each document: its span, its tokens, and those that cross its end."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            sizes = []
            for text, (_, starts, ends) in zip(texts, encoded(texts, path)):
                bounds = line_starts(text)
                owner, crossing = attribute(bounds, starts, ends)
                n = len(bounds)
                sizes.append(n)
                parts = (np.arange(n), bounds, np.append(bounds[1:], len(text)),
                         np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n))
                for column, part in zip(columns, parts):
                    column.append(part)
            if not sizes:
                continue
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            kinds = (np.int32, np.int32, np.int32, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(np.concatenate(c).astype(k)) for c, k in zip(columns, kinds)]],
                names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return docs.select("doc_id", "text").mapInArrow(count, SECTIONS)
