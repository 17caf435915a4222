"""Lineage cuts for operators that loop."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, computed once into the session's spark.checkpoint.dir (where unset and Spark runs on this machine alone, a folder in the warehouse)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "kept"))
    return df.checkpoint()
