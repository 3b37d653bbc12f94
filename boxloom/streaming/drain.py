"""Running a stream over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxloom.session import scratch_path

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State store that keeps large state on disk; the custom stateful operator needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process all available input into a written table and read that table.

    Output and checkpoint go below the shared folder, so a restarted driver resumes.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    running = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
