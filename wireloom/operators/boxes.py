"""Joins of boxes by grid cells.

A drawing's plane is cut into square cells.  Boxes go to the cells that they touch and meet there by an
equi-join; a pair counts in the one cell that holds the lower corner of what both reach, so no
pair comes twice and no duplicate removal is needed.  A crowded drawing spreads over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.geometry import Box, gap, iou, overlap_of_smaller, union

CELL = 256
#: Cells on either side of the origin; what lies farther shares the last, so that no box has cells without end.
MOST = 1 << 10


def cell_of(place: Column, cell: int) -> Column:
    return F.least(F.greatest(F.floor(place / cell), F.lit(-MOST)), F.lit(MOST))


def in_cells(df: DataFrame, prefix: str, reach: int, cell: int) -> DataFrame:
    def along(axis: str) -> Column:
        low, high = (cell_of(F.col(f"{prefix}{axis}{k}") + d, cell) for k, d in ((0, -reach), (1, reach)))
        return F.explode(F.sequence(low, F.greatest(low, high)))

    return df.withColumn("cell_x", along("x")).withColumn("cell_y", along("y"))


def meeting(a: DataFrame, b: DataFrame, by: list[str], reach: int = 0, cell: int = CELL, on: Column | None = None) -> DataFrame:
    """Pairs of boxes of a (columns a_...) and b (columns b_...) of the same `by` whose gap along both axes is at most reach."""
    left, right = in_cells(a, "a_", reach, cell), in_cells(b, "b_", 0, cell)
    p, q = Box("a_"), Box("b_")
    near = (p.x0 - reach <= q.x1) & (q.x0 <= p.x1 + reach) & (p.y0 - reach <= q.y1) & (q.y0 <= p.y1 + reach)
    corner = (cell_of(F.greatest(p.x0 - reach, q.x0), cell) == F.col("cell_x")) & (cell_of(F.greatest(p.y0 - reach, q.y0), cell) == F.col("cell_y"))
    met = left.join(right, [*by, "cell_x", "cell_y"]).where(near & corner)
    return (met if on is None else met.where(on)).drop("cell_x", "cell_y")


def named(df: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    """Columns but `by` get the prefix."""
    return df.select(*by, *[F.col(c).alias(prefix + c) for c in df.columns if c not in by])


def iou_pairs(gold: DataFrame, pred: DataFrame, least: float = 0.5, by: str = "drawing_id") -> DataFrame:
    """Pairs whose intersection over union is `least` or more, with it as iou."""
    met = meeting(named(gold, "a_", [by]), named(pred, "b_", [by]), [by])
    return met.withColumn("iou", iou(Box("a_"), Box("b_"))).where(F.col("iou") >= least)


def overlapping(boxes: DataFrame, least: float = 0.5, by: str = "drawing_id") -> DataFrame:
    """Pairs of boxes, first idx below second, whose shared area is `least` of the smaller's, with it as overlap and their union."""
    met = meeting(named(boxes, "a_", [by]), named(boxes, "b_", [by]), [by], on=F.col("a_idx") < F.col("b_idx"))
    met = met.withColumn("overlap", overlap_of_smaller(Box("a_"), Box("b_"))).where(F.col("overlap") >= least)
    return met.select(*met.columns, *union(Box("a_"), Box("b_")))


def near_tokens(symbols: DataFrame, tokens: DataFrame, most: int = 45, by: str = "drawing_id") -> DataFrame:
    """Pairs of a symbol and a token at most `most` apart, with the distance."""
    met = meeting(named(symbols, "a_", [by]), named(tokens, "b_", [by]), [by], reach=most)
    return met.withColumn("distance", gap(Box("a_"), Box("b_"))).where(F.col("distance") <= most)
