"""Coverage kept up to date while labels arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.operators.coverage import label_counts

#: Versions of the count table that stay: the current one, and the one a repeated batch starts from.
KEPT = 2


def running_counts(labels: DataFrame) -> DataFrame:
    """Counts per split and class of a label stream, for update or complete mode.

    State holds one number per split and class. A batch recount stays the authority.
    """
    return label_counts(labels)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions below ``path``, ascending."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(java):
        return []
    found = store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/batch={version:012d}"


def merge_batch(labels: DataFrame, batch: int, path: str) -> None:
    """Add a batch of labels to the counts below ``path``, as version ``batch``.

    The version is the one before plus the batch, so a batch that comes again is merged into the
    same version and gives it the same counts. Older versions than the last two go.
    """
    spark = labels.sparkSession
    before = [v for v in _versions(spark, path) if v < batch]
    counts = label_counts(labels).select("split", "class_id", "n")
    if before:
        earlier = spark.read.parquet(_folder(path, before[-1])).select("split", "class_id", "n")
        counts = earlier.union(counts).groupBy("split", "class_id").agg(F.sum("n").alias("n"))
    counts.write.mode("overwrite").parquet(_folder(path, batch))
    for version in [v for v in _versions(spark, path) if v <= batch][:-KEPT]:
        java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(path, version))
        java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(java, True)


def write_counts(labels: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that merges each batch of a label stream into the counts below ``path``.

    ``trigger`` as in ``DataStreamWriter.trigger``; without one, all there is now.
    """
    return (
        labels.writeStream.outputMode("append").foreachBatch(lambda rows, batch: merge_batch(rows, batch, path))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of the newest finished version; none before the first batch."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], "split string, class_id bigint, n bigint")
    return spark.read.parquet(_folder(path, versions[-1]))
