"""The class of a slot, computed from its number alone.

Slots of a split fill the lowest classes level by level. Between two counts at which classes come
in, the classes in play stay the same, so the level of slot *k* and its place in the level follow
from a step function by binary search and division. The class at that place is the r-th in order
of need among the classes that have come in: a wavelet matrix over the registry finds it in as
many array steps as the number of classes has bits. No seat is a row, nothing is sorted or
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


class SeatIndex:
    """Seats of one split, from its quotas ``(class_id, n, quota)`` in order of need.

    All quotas must fill to one level, or one above it (as ``class_quota`` gives them).
    """

    def __init__(self, class_id: np.ndarray, n: np.ndarray, quota: np.ndarray):
        self.class_id, ends = class_id, n + quota
        self.level = int(ends.min())
        if int(ends.max()) > self.level + 1:
            raise ValueError("quotas do not fill to one level")
        self.last = np.flatnonzero(ends > self.level)
        full = np.flatnonzero(n < self.level)
        by_count = full[np.argsort(n[full], kind="stable")]
        self.first, at = np.unique(n[by_count], return_index=True)
        self.size = np.append(at[1:], len(by_count))
        spans = np.diff(np.append(self.first, self.level)) * self.size
        self.start = np.concatenate([[0], np.cumsum(spans)])
        self.bits = max(1, int(len(class_id) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        places = by_count
        for bit in reversed(range(self.bits)):
            low = (places >> bit & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            places = np.concatenate([places[low], places[~low]])

    def __len__(self) -> int:
        return int(self.start[-1]) + len(self.last)

    def _nth(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place in order of need of the class of ``rank`` among the first ``size`` that came in."""
        low, high, place = np.zeros_like(size), size.copy(), np.zeros_like(size)
        rank = rank.copy()
        for zeros in self.zeros:
            below_low, below_high = zeros[low], zeros[high]
            inside = below_high - below_low
            right = rank >= inside
            place = place * 2 + right
            rank -= np.where(right, inside, 0)
            low = np.where(right, zeros[-1] + low - below_low, below_low)
            high = np.where(right, zeros[-1] + high - below_high, below_high)
        return place

    def seats(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class_id, level) of slot numbers; -1 where there is no such slot."""
        class_id, level = np.full(len(slot), -1, np.int64), np.full(len(slot), -1, np.int64)
        common = (slot >= 0) & (slot < self.start[-1])
        k = slot[common]
        step = np.searchsorted(self.start, k, side="right") - 1
        size = self.size[step] if len(step) else k
        up, rank = np.divmod(k - self.start[step], size) if len(step) else (k, k)
        class_id[common] = self.class_id[self._nth(size, rank)]
        level[common] = (self.first[step] if len(step) else k) + up
        top = (slot >= self.start[-1]) & (slot < len(self))
        class_id[top] = self.class_id[self.last[slot[top] - self.start[-1]]]
        level[top] = self.level
        return class_id, level


def with_seats(slots: DataFrame, index: dict[str, SeatIndex], makeup_min: int = 0) -> DataFrame:
    """``slots`` (split, slot_no, ...) with class_id, level and makeup; slots beyond the seats go."""
    schema = StructType([*slots.schema.fields, StructField("class_id", LongType()), StructField("level", LongType()),
                         StructField("makeup", BooleanType())])
    at_split, at_slot = slots.columns.index("split"), slots.columns.index("slot_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(at_split).dictionary_encode()
            of_row = named.indices.to_numpy(zero_copy_only=False)
            slot = batch.column(at_slot).to_numpy(zero_copy_only=False)
            class_id, level = np.full(len(slot), -1, np.int64), np.full(len(slot), -1, np.int64)
            for k, split in enumerate(named.dictionary.to_pylist()):
                if split in index:
                    rows = of_row == k
                    class_id[rows], level[rows] = index[split].seats(slot[rows])
            whole = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(class_id), pa.array(level), pa.array(level < makeup_min)], names=schema.names)
            yield whole.filter(pa.array(level >= 0))

    return slots.mapInArrow(run, schema)
