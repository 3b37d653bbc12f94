"""Session settings and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPLITS = ("train", "valid", "test")


def build_session(app: str = "boxloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; sizes are left to the cluster's own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Generated methods above this size are not compiled by the JVM; smaller ones are.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where none is named, a temporary one is made if driver and executors are one process
    (``local[n]``); every other master has to name a folder all executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="boxloom-")
    context.setCheckpointDir(made)
    return made


def drop_tables(*tables: DataFrame) -> None:
    """Delete written tables (of ``durable``) that nothing reads any more.

    Only folders below the shared one go, so a caller's own table is never touched.
    """
    for table in tables:
        spark = table.sparkSession
        java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = java(shared_folder(spark))
        root = root.getFileSystem(conf).makeQualified(root)
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = java(folder)
            if path.getParent().toUri().getPath() == root.toUri().getPath():
                path.getFileSystem(conf).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    A written table outlives lost executors, carries statistics for later joins, and is
    computed once where ``checkpoint`` would compute its last stage twice.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
