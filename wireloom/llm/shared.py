"""The folder that every executor sees, for lineage cuts and written files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset and Spark runs on this machine alone (as in tests), a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "shared")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that lost executors cost no more than a reread."""
    folder(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """A kept table, marked for broadcast if its counted rows, of row_bytes at most, fit in `most` bytes; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df
