"""Stateful steps that take the rows of a session in order, whatever order they arrive in.

Rows wait in state until the watermark has passed their time and are then taken in order. So which
rows are late depends on their time alone, and the same rows give the same result in any order
and in any cut into batches, as long as none is older than the watermark's delay allows.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from boxloom.streaming import live


#: What the rule reads of a box.
_SHOWN = ("box_no", "class_id", "x1", "y1", "x2", "y2")


def after(at: int) -> int:
    """The first whole millisecond past a time in microseconds; watermarks and timers have no finer one."""
    return at // 1000 + 1


class InOrder(StatefulProcessor):
    """Base: rows (with ``at``, their time in microseconds) are stored as ``WAITING`` says, released by event time in the order of ``place``.

    ``packed`` turns an input row into a stored one (None: nothing to store), ``take`` turns a
    released row and the memory into an output row (or None) and the new memory.
    """

    WAITING = MEMORY = OUTPUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at bigint, {self.WAITING}")
        self.memory = handle.getValueState("memory", self.MEMORY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            stored = []
            for row in part.itertuples(index=False):
                found = self.packed(row)
                if found is not None:
                    stored.append((int(row.at), *found))
            if stored:
                self.waiting.appendList(stored)
                first = min([s[0] for s in stored] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(after(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for row in self.waiting.get():
            (ready if row[0] <= now else later).append(tuple(row))
        if not ready:
            return
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(after(min(row[0] for row in later)))
        else:
            self.waiting.clear()
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        out = []
        for row in sorted(ready, key=self.place):
            made, memory = self.take(row, memory)
            if made is not None:
                out.append((int(key[0]), *made))
        if memory is not None:
            self.memory.update(memory)
        if out:
            names = [c.split()[0] for c in self.OUTPUT.split(", ")]
            # Whole numbers stay whole beside missing ones.
            yield pd.DataFrame({n: pd.array(list(c), dtype="Int64") for n, c in zip(names, zip(*out))})

    def place(self, row: tuple):
        raise NotImplementedError

    def packed(self, row):
        raise NotImplementedError

    def take(self, row: tuple, memory: tuple | None):
        raise NotImplementedError

    def close(self) -> None:
        pass


class PointerAtFrame(InOrder):
    """The last pointer position at or before each frame."""

    WAITING = "kind int, number bigint, px bigint, py bigint"
    MEMORY = "px bigint, py bigint"
    OUTPUT = "session_id bigint, frame_no bigint, px bigint, py bigint"

    def __init__(self, start: tuple[int, int] = (0, 0)):
        self.start = start

    def place(self, row: tuple):
        return row[:3]  # time, pointers before frames, number

    def packed(self, row):
        if pd.isna(row.number):
            return None
        return (int(row.kind), int(row.number), *(None if pd.isna(v) else int(v) for v in (row.px, row.py)))

    def take(self, row: tuple, memory: tuple | None):
        _, kind, number, px, py = row
        if kind == 0:
            return None, (px, py)
        return (number, *(memory or self.start)), memory


class Frame:
    """A stored frame, as ``OverlayMemory.one_frame`` reads it."""

    def __init__(self, px: int, py: int, shown: str):
        self.px, self.py, self.shown = px, py, json.loads(shown)


class OrderedOverlay(InOrder):
    """``live.OverlayMemory`` on frames in order of their number.

    A frame numbered below one already taken is dropped and counted; with clocks that rise with the
    frame number this happens only to frames older than the watermark.
    """

    WAITING = "frame_no bigint, px bigint, py bigint, shown string"
    MEMORY = "x bigint, y bigint, w bigint, h bigint, frame_no bigint, late bigint"
    OUTPUT = live.OVERLAY_OUTPUT

    def __init__(self, rule: live.OverlayMemory):
        self.rule = rule

    def place(self, row: tuple):
        return row[1], row[0]

    def packed(self, row):
        if pd.isna(row.frame_no):
            return None
        return int(row.frame_no), int(row.px), int(row.py), row.shown

    def take(self, row: tuple, memory: tuple | None):
        _, frame_no, px, py, shown = row
        rect = memory[:4] if memory and memory[0] is not None else None
        last, late = memory[4:] if memory else (None, 0)
        if last is not None and frame_no <= last:
            return None, (*memory[:5], late + 1)
        made, rect = self.rule.one_frame(Frame(px, py, shown), rect)
        return (frame_no, *made, late), (*(rect or (None,) * 4), frame_no, late)


def _run(rows: DataFrame, processor: InOrder) -> DataFrame:
    # The Python side of the operator starts without this package on its path.
    for module in (sys.modules[__name__], live):
        cloudpickle.register_pickle_by_value(module)
    return rows.withColumn("at", F.unix_micros("ts")).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode="EventTime")


def pointer_at_frames(frames: DataFrame, pointers: DataFrame, watermark: str, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """Streamed as-of join: frames (session_id, frame_no, ts) with the last of pointers (session_id,
    event_id, ts, px, py) at or before them. A row without number only moves the watermark."""
    none = F.lit(None).cast("bigint")
    both = frames.select("session_id", "ts", F.lit(1).alias("kind"), F.col("frame_no").alias("number"), none.alias("px"), none.alias("py")).union(
        pointers.select("session_id", "ts", F.lit(0).alias("kind"), F.col("event_id").alias("number"), "px", "py"))
    return _run(both.withWatermark("ts", watermark), PointerAtFrame(start))


def overlay_in_order(frames: DataFrame, rule: live.OverlayMemory, watermark: str) -> DataFrame:
    """The overlay memory over a stream of frames (session_id, frame_no, ts, px, py, shown) in any order."""
    # Boxes pass through Python as they are stored: one text a frame.
    shown = F.to_json(F.transform("shown", lambda b: F.struct(*[b[c].alias(c) for c in _SHOWN])), {"ignoreNullFields": "false"})
    rows = frames.select("session_id", "frame_no", "ts", "px", "py", shown.alias("shown")).withWatermark("ts", watermark)
    return _run(rows, OrderedOverlay(rule))
