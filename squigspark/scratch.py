"""Folders that the driver and all executors share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; in local mode a temporary one if it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return posixpath.join(shared or tempfile.mkdtemp(prefix="spark-signals-"), f"{what}-{uuid.uuid4().hex}")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many partitions as there are cores, if it has fewer; else as it is, so nothing large is dealt anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
