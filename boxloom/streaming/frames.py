"""Frames from detection rows as they arrive.

A frame is complete when all its boxes are there. A heartbeat of the frame says how many these are,
so an empty frame comes out with its heartbeat, the newest one need not wait for a later frame, and
neither the order of rows nor their cut into batches changes the result. A frame whose heartbeat or
boxes stay away comes out as it is, marked incomplete, once the watermark has passed its time.
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

BOX = ("box_no", "class_id", "score", "x1", "y1", "x2", "y2")
#: Groups that frames are dealt to by hash.
BUCKETS = 2_048
_STORED = "box_no bigint, class_id bigint, score double, x1 double, y1 double, x2 double, y2 double"
FRAME = f"session_id bigint, frame_no bigint, at bigint, complete boolean, boxes array<struct<{_STORED.replace(' ', ':').replace(',:', ',')}>>"


class FrameAssembly(StatefulProcessor):
    """State per bucket of frames. Of a frame: its time in microseconds, when it is due, what the heartbeat
    said, whether it is out, and its boxes so far, in JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState(
            "frames", "session_id bigint, frame_no bigint", "at bigint, due bigint, wanted bigint, out boolean, boxes string")
        self.next = handle.getValueState("next", "due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = self.frames.exists()
        touched: dict[tuple[int, int], list] = {}
        for part in rows:
            for row in part.itertuples(index=False):
                name = (int(row.session_id), int(row.frame_no))
                frame = touched.get(name)
                if frame is None:
                    frame = touched[name] = self.known(name) if some else [None, None, None, False, {}]
                frame[0] = int(row.at) if frame[0] is None else min(frame[0], int(row.at))
                if row.has_n:
                    frame[2] = int(row.n_boxes)
                if row.has_box:
                    frame[4][int(row.box_no)] = (int(row.box_no), int(row.class_id), *[float(getattr(row, c)) for c in BOX[2:]])
        ready, due = [], None
        for name, frame in touched.items():
            at, own, wanted, out, boxes = frame
            if out:
                continue
            if own is None:
                own = at // 1000 + 1
                due = own if due is None else min(due, own)
            if wanted is not None and len(boxes) >= wanted:
                ready.append((name, at, boxes))
                self.frames.updateValue(name, (at, own, wanted, True, None))
            else:
                self.frames.updateValue(name, (at, own, wanted, False, json.dumps(list(boxes.values()))))
        if due is not None:
            self.wake(due)
        if ready:
            yield self.released(ready, True)

    def known(self, name: tuple[int, int]) -> list:
        found = self.frames.getValue(name) if self.frames.containsKey(name) else None
        if found is None:
            return [None, None, None, False, {}]
        at, due, wanted, out, boxes = found
        return [at, due, wanted, out, {b[0]: tuple(b) for b in json.loads(boxes or "[]")}]

    def wake(self, due: int) -> None:
        """One timer, at the time of the earliest frame."""
        first = self.next.get()[0] if self.next.exists() else None
        if first is None or due < first:
            self.handle.registerTimer(due)
            self.next.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        passed, later = [], None
        for name, frame in self.frames.iterator():
            if frame[1] <= now:
                passed.append((tuple(name), tuple(frame)))
            else:
                later = frame[1] if later is None else min(later, frame[1])
        ready = []
        for name, (at, _, _, out, boxes) in passed:
            if not out:
                ready.append((name, at, {b[0]: tuple(b) for b in json.loads(boxes or "[]")}))
            self.frames.removeKey(name)
        self.next.clear()
        if later is not None:
            self.wake(later)
        if ready:
            yield self.released(ready, False)

    def released(self, frames: list[tuple], complete: bool) -> pd.DataFrame:
        return pd.DataFrame({
            "session_id": [int(name[0]) for name, _, _ in frames], "frame_no": [int(name[1]) for name, _, _ in frames],
            "at": [at for _, at, _ in frames], "complete": [complete] * len(frames),
            "boxes": [[dict(zip(BOX, boxes[n])) for n in sorted(boxes)] for _, _, boxes in frames]})

    def close(self) -> None:
        pass


def assemble_frames(detections: DataFrame, heartbeats: DataFrame, watermark: str, buckets: int = BUCKETS) -> DataFrame:
    """Frames (session_id, frame_no, ts, complete, boxes) from two streams.

    ``detections``: session_id, frame_no, ts and the box; ``heartbeats``: session_id, frame_no, ts,
    n_boxes. State is kept per frame in buckets of frames, so a busy session is spread over tasks and
    a task starts once for each bucket, not for each frame; a stream keeps the ``buckets`` it began with.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # No nulls beside whole numbers, which would make them fractions.
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    own = detections.select(
        "session_id", "frame_no", "ts", no.alias("has_n"), zero.alias("n_boxes"), F.col("box_no").isNotNull().alias("has_box"),
        F.coalesce("box_no", zero).alias("box_no"), *BOX[1:])
    beats = heartbeats.select(
        "session_id", "frame_no", "ts", F.col("n_boxes").isNotNull().alias("has_n"), F.coalesce("n_boxes", zero).alias("n_boxes"),
        no.alias("has_box"), zero.alias("box_no"), zero.alias("class_id"), *[F.lit(0.0).alias(c) for c in BOX[2:]])
    rows = own.union(beats).withWatermark("ts", watermark).withColumn("at", F.unix_micros("ts")).withColumn(
        "bucket", F.pmod(F.xxhash64("session_id", "frame_no"), F.lit(buckets)))
    found = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=FrameAssembly(), outputStructType=FRAME, outputMode="Append", timeMode="EventTime")
    return found.select("session_id", "frame_no", F.timestamp_micros("at").alias("ts"), "complete", "boxes")
