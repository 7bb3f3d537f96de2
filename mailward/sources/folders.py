"""The folder that the driver and all executors share, for what queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a local session may do without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='mailward-')}"
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/mailward/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a URI, for any storage that the session reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a batch writer has finished this folder."""
    store, target = hadoop_path(spark, f"{path}/_SUCCESS")
    return store.exists(target)
