"""Runs of consecutive integers, and sums over neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(points: DataFrame, by: list[str], at: str, least: int = 1) -> DataFrame:
    """(by..., start, stop, length): the maximal runs of consecutive values of the integer column, `least` long or more.

    Repeated values are removed first, so a window holds no more rows than its distinct values.
    """
    distinct = points.select(*by, at).where(F.col(at).isNotNull()).distinct()
    island = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    found = distinct.withColumn("island", island).groupBy(*by, "island").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("length"))
    return found.where(F.col("length") >= least).drop("island")


def longest(found: DataFrame, by: list[str]) -> DataFrame:
    """The longest run each, the first on ties."""
    best = F.max(F.struct("length", (-F.col("start")).alias("first"), "stop")).alias("best")
    return found.groupBy(*by).agg(best).select(*by, (-F.col("best.first")).alias("start"), "best.stop", "best.length")


def windowed_sums(cells: DataFrame, x: str, y: str, value: str, reach: int) -> DataFrame:
    """Adds to each cell (x, y) the sum of value over the square of cells within `reach` along both axes.

    One axis after the other: cells go to the places whose windows hold them and are added up there.
    """

    def along(df: DataFrame, axis: str, other: str) -> DataFrame:
        spread = df.select(other, F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach)).alias(axis), value)
        return spread.groupBy(other, axis).agg(F.sum(value).alias(value))

    total = along(along(cells.select(x, y, value), x, y), y, x).withColumnRenamed(value, "around")
    return cells.join(total, [x, y])
