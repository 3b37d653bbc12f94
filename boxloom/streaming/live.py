"""The live loop over detection frames.

A frame is one row: session, frame number, time, pointer and its detections as an array.
Everything that concerns one frame is a column expression, so the same function serves a
table and a stream. Only the overlay memory carries state between frames.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from boxloom.functions.geometry import box, live_shape, preview_corner
from boxloom.operators.lookup import first_hovered, urls_by_name
from boxloom.operators.registry import with_class_labels
from boxloom.operators.suppress import fold_boxes
from boxloom.plans.skew import small_side

# Live confidence and overlap thresholds, most detections per frame,
# size of the preview card in pixels.
CONFIDENCE, SUPPRESS_IOU, MAX_DETECTIONS = 0.69, 0.50, 300
PREVIEW_SIZE = (300, 420)

BOXES = ("array<struct<box_no:bigint,class_id:bigint,score:double,"
         "x1:double,y1:double,x2:double,y2:double>>")

# Most classes whose ids are sent to every task of the overlay memory.
MAX_PREVIEW_CLASSES = 1_000_000


def collect_frames(detections: DataFrame, watermark: str) -> DataFrame:
    """Frames from detection rows; in a stream a frame is complete once the watermark passed it."""
    rows = detections.withWatermark("ts", watermark) if detections.isStreaming else detections
    return rows.groupBy("session_id", "frame_no", "ts").agg(F.collect_list(F.struct(
        "box_no", "class_id", "score", "x1", "y1", "x2", "y2")).alias("boxes"))


def frame_boxes(boxes: Column, width: int, height: int, confidence: float = CONFIDENCE,
                threshold: float = SUPPRESS_IOU, max_boxes: int = MAX_DETECTIONS) -> Column:
    """Threshold, per-class suppression, cap and shape filter, in that order."""
    sure = F.filter(F.coalesce(boxes, F.array().cast(BOXES)), lambda b: b["score"] >= confidence)
    ranked = F.sort_array(F.transform(sure, lambda b: F.struct(
        (-b["score"]).alias("at"), b["box_no"].alias("box_no"), b["class_id"].alias("class_id"),
        b["score"].alias("score"), *[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")])))
    capped = F.slice(fold_boxes(ranked, threshold, "class_id"), 1, max_boxes)
    return F.filter(capped, lambda b: live_shape(box(b), F.lit(width), F.lit(height)))


def live_view(frames: DataFrame, names: DataFrame, width: int, height: int,
              confidence: float = CONFIDENCE, threshold: float = SUPPRESS_IOU) -> DataFrame:
    """Each frame with its shown boxes and the class under the pointer.

    ``frames``: session_id, frame_no, ts, px, py, boxes. ``names``: class_id, name.
    """
    shown = frames.withColumn("shown", frame_boxes(F.col("boxes"), width, height, confidence, threshold))
    hit = shown.withColumn("_hit", first_hovered(F.col("shown"), F.col("px"), F.col("py")))
    preview_x, preview_y = preview_corner(
        box(F.col("_hit")), F.lit(width), F.lit(height), F.lit(PREVIEW_SIZE[0]), F.lit(PREVIEW_SIZE[1]))
    flat = hit.select(
        "session_id", "frame_no", "ts", F.size("shown").alias("n_shown"),
        F.col("_hit.box_no").alias("box_no"), F.col("_hit.class_id").alias("class_id"),
        F.when(F.col("_hit").isNotNull(), preview_x).alias("preview_x"),
        F.when(F.col("_hit").isNotNull(), preview_y).alias("preview_y"))
    return with_class_labels(flat, names)


def preview_links(view: DataFrame, class_names: DataFrame, cards: DataFrame) -> DataFrame:
    """Hovered frames with the image URL of their class (stream-static join)."""
    links = urls_by_name(class_names.select("name").distinct(), cards).select(
        F.col("name").alias("label"), "image_url")
    return view.filter(F.col("class_id").isNotNull()).join(small_side(links), "label", "left")


def first_uses(linked: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each URL once: what has to be fetched.

    A stream remembers every URL it has given out, so its state holds at most the catalog's URLs
    and nothing is fetched twice, however late it is shown again. With ``watermark`` URLs are
    forgotten after that time, for catalogs whose URLs keep changing.
    """
    wanted = linked.filter(F.col("image_url").isNotNull()).select("image_url", "ts")
    if not linked.isStreaming:
        return wanted.groupBy("image_url").agg(F.min("ts").alias("ts"))
    if watermark is None:
        return wanted.dropDuplicates(["image_url"])
    return wanted.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["image_url"])


OVERLAY_OUTPUT = (
    "session_id bigint, frame_no bigint, n_seen bigint, n_hidden bigint, box_no bigint, "
    "class_id bigint, overlay_x bigint, overlay_y bigint, late bigint")
_MEMORY = "x bigint, y bigint, w bigint, h bigint, frame_no bigint, late bigint"


def hidden_share(b, rect: tuple[int, int, int, int], width: int, height: int) -> float:
    """Share of a box under the overlay, which is cut at the canvas."""
    x, y, w, h = rect
    wide = min(b["x2"], x + w, width) - max(b["x1"], x, 0)
    tall = min(b["y2"], y + h, height) - max(b["y1"], y, 0)
    size = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    return wide * tall / size if wide > 0 and tall > 0 and size > 0 else 0.0


class OverlayMemory(StatefulProcessor):
    """Hides boxes under the overlay which the frame before has left on screen.

    State per session: the last overlay rectangle, the last frame handled and the number
    of late frames. Frames of a batch are handled in order of their number; a frame older
    than the last one handled is dropped and counted.
    """

    def __init__(self, with_preview: frozenset[int], width: int, height: int,
                 drop_share: float = 0.5, masking: bool = True, ttl_ms: int | None = None):
        self.with_preview = with_preview
        self.size = (width, height)
        self.drop_share = drop_share
        self.masking = masking
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", _MEMORY, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("frame_no")
        known = self.memory.get() if self.memory.exists() else None
        rect = tuple(known[:4]) if known and known[0] is not None else None
        last, late = (known[4], known[5]) if known else (None, 0)
        out = []
        for frame in frames.itertuples(index=False):
            if last is not None and frame.frame_no <= last:
                late += 1
                continue
            last = int(frame.frame_no)
            row, rect = self.one_frame(frame, rect)
            out.append((int(key[0]), last, *row, late))
        self.memory.update((*(rect or (None,) * 4), last, late))
        names = [c.split()[0] for c in OVERLAY_OUTPUT.split(", ")]
        if out:
            # Whole numbers stay whole beside missing ones.
            yield pd.DataFrame({n: pd.array(list(c), dtype="Int64") for n, c in zip(names, zip(*out))})

    def one_frame(self, frame, rect):
        """Figures of one frame, and the overlay rectangle that the next frame meets."""
        seen = [
            b for b in frame.shown
            if not (self.masking and rect and hidden_share(b, rect, *self.size) >= self.drop_share)
        ]
        hit = next((
            b for b in seen
            if int(b["x1"]) <= frame.px <= int(b["x2"]) and int(b["y1"]) <= frame.py <= int(b["y2"])
        ), None)
        hidden = len(frame.shown) - len(seen)
        if hit is None:
            return (len(seen), hidden, None, None, None, None), rect
        found = (len(seen), hidden, int(hit["box_no"]), int(hit["class_id"]))
        if int(hit["class_id"]) not in self.with_preview:
            return (*found, None, None), rect
        (width, height), (w, h) = self.size, PREVIEW_SIZE
        x = max(0, min(int(hit["x1"]), width - w))
        y = max(0, min(int(hit["y2"]) + 10, height - h))
        return (*found, x, y), ((x, y, w, h) if self.masking else None)

    def close(self) -> None:
        pass


def remember_overlay(frames: DataFrame, memory: OverlayMemory) -> DataFrame:
    """Runs the overlay memory over a stream of frames (session_id, frame_no, px, py, shown)."""
    # The Python side of the operator starts without this package on its path.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return frames.select("session_id", "frame_no", "px", "py", "shown").groupBy(
        "session_id").transformWithStateInPandas(
        statefulProcessor=memory, outputStructType=OVERLAY_OUTPUT, outputMode="Append", timeMode="None"
        if memory.ttl_ms is None else "ProcessingTime")
