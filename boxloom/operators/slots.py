"""Slot proposal: the whole chain from detections to one record per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import box, slot_shape
from boxloom.operators.suppress import keep_best
from boxloom.plans.skew import top_k
from boxloom.sinks.tables import slot_records

# Detector confidence and overlap, most detections an image, overlap of slots,
# most slots an image.
CONFIDENCE, DETECTOR_IOU, MAX_DETECTIONS, SLOT_IOU, MAX_SLOTS = 0.20, 0.50, 300, 0.25, 30


def propose_slots(boxes: DataFrame, images: DataFrame, image: str, order: list[Column], width: Column,
                  height: Column, confidence: float = CONFIDENCE, max_slots: int = MAX_SLOTS) -> DataFrame:
    """(image, slots, candidates) of every image, best slot first.

    ``boxes`` (image, score in [0, 1], corners) pass the detector's threshold, class-blind
    suppression and cap, then the slot shape, a closer suppression, and the slot cap.
    """
    sure = boxes.filter(F.col("score") >= confidence)
    found = keep_best(sure, [image], order, DETECTOR_IOU, MAX_DETECTIONS)
    shaped = found.filter(slot_shape(box(), width, height))
    kept = top_k(keep_best(shaped, [image], order, SLOT_IOU), [image], order, max_slots)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return slot_records(kept.withColumn("_place", place), images, image, "_place")
