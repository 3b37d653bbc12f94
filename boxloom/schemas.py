"""Explicit schemas of every external input."""

from __future__ import annotations

from pyspark.sql import types as T

PRINTING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("set_id", T.StringType()),
    T.StructField("image_url", T.StringType()),
])

CARD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("printings", T.ArrayType(PRINTING)),
])

LABEL = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("stem", T.StringType()),
    T.StructField("box_no", T.LongType()),
    T.StructField("class_id", T.LongType()),
    T.StructField("cx", T.DoubleType()),
    T.StructField("cy", T.DoubleType()),
    T.StructField("w", T.DoubleType()),
    T.StructField("h", T.DoubleType()),
])

REGISTRY = T.StructType([
    T.StructField("class_id", T.LongType()),
    T.StructField("name", T.StringType()),
])

CLASS_LIST = T.StructType([T.StructField("names", T.ArrayType(T.StringType()))])

COVERAGE = T.StructType([
    T.StructField("class_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("n", T.LongType()),
])

DETECTION = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("frame_no", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("box_no", T.LongType()),
    T.StructField("class_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
])

# The metric columns of a training log, in file order.
METRIC_COLUMNS = (
    "epoch", "time",
    "train/box_loss", "train/cls_loss", "train/dfl_loss",
    "metrics/precision(B)", "metrics/recall(B)", "metrics/mAP50(B)", "metrics/mAP50-95(B)",
    "val/box_loss", "val/cls_loss", "val/dfl_loss",
    "lr/pg0", "lr/pg1", "lr/pg2",
)

METRICS_CSV = T.StructType([
    T.StructField(name, T.IntegerType() if name == "epoch" else T.DoubleType())
    for name in METRIC_COLUMNS
])
