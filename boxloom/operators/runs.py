"""Reports over training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.plans.running import Running, running

EPOCHS_PER_BUCKET = 4096


def epoch_report(metrics: DataFrame, time: str, metric: str, run: str = "run",
                 epoch: str = "epoch") -> DataFrame:
    """Each epoch with its own seconds (from the cumulative time) and the best metric so far."""
    ran = running(
        metrics, [run], F.floor(F.col(epoch) / EPOCHS_PER_BUCKET), [F.col(epoch)],
        _earlier=Running("last", F.col(time), inclusive=False),
        best_so_far=Running("max", F.col(metric)),
    )
    return ran.withColumn(
        "epoch_time", F.col(time) - F.coalesce("_earlier", F.lit(0))).drop("_earlier")


def best_epochs(metrics: DataFrame, columns: list[str], run: str = "run", epoch: str = "epoch",
                lowest: tuple[str, ...] = ()) -> DataFrame:
    """First epoch with the best value of every metric column, one row per run and metric."""
    def best(name: str) -> Column:
        value = -F.col(name) if name in lowest else F.col(name)
        return F.struct(F.lit(name).alias("metric"), F.max_by(
            F.struct(F.col(epoch).alias("epoch"), F.col(name).cast("double").alias("value")),
            F.struct(value, -F.col(epoch))).alias("at"))

    rows = metrics.groupBy(run).agg(F.array(*[best(c) for c in columns]).alias("_b"))
    return rows.select(run, F.explode("_b").alias("_m")).select(
        run, "_m.metric", F.col("_m.at.epoch").alias("epoch"), F.col("_m.at.value").alias("value"))


def run_summary(metrics: DataFrame, time: str, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Epochs, total time and mean time per epoch of each run."""
    return metrics.groupBy(run).agg(
        F.count(F.lit(1)).alias("epochs"), F.max(time).alias("total_time"),
        (F.max(time) / F.count(F.lit(1))).alias("mean_time"))
