"""boxloom: box-label datasets and detections as Spark DataFrames and streams."""

__version__ = "0.1.0"
