"""Arrow batches in small slices, so that a task's Python side holds little at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_binary(df: DataFrame, source: str, name: str, values: Callable[[list], Iterator[bytes | None]],
                keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and a binary column made from the column ``source``."""
    schema = StructType([*[df.schema[c] for c in keep], StructField(name, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = pa.array(values(batch.column(0).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names=[*keep, name])

    return df.select(df[source].alias("_source"), *[df[c] for c in keep]).mapInArrow(run, schema)
