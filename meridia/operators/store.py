"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master gets a temporary folder, and a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meridia-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/meridia/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, after the table of old, which no later step reads, is deleted."""
    spark = old.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old.cut_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return new
