"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir (under one of our own where that is unset, in local mode only), which
    goes when the driver's JVM ends."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(where)
    path = f"{where.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """df written under path (a folder a value of by) and read again: cuts lineage, survives lost executors."""
    (df.repartition(by).write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)
