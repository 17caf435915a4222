"""Box and angle expressions.

A box is four integer columns x0, y0, x1, y1 with a prefix, half open.  All results are doubles
unless they are coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """The four columns of a box."""

    def __init__(self, prefix: str = ""):
        self.x0, self.y0, self.x1, self.y1 = (F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))

    @property
    def area(self) -> Column:
        return (self.x1 - self.x0).cast("long") * (self.y1 - self.y0)


def shared_area(a: Box, b: Box) -> Column:
    """Area that both boxes cover; 0 if they only touch or are apart."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w.cast("long") * h).otherwise(0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole isn't positive."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    shared = shared_area(a, b)
    return ratio(shared, a.area + b.area - shared)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return ratio(shared_area(a, b), F.least(a.area, b.area))


def union(a: Box, b: Box) -> list[Column]:
    ends = (F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))
    return [c.alias(n) for c, n in zip(ends, ("x0", "y0", "x1", "y1"))]


def gap(a: Box, b: Box) -> Column:
    """Distance of the nearest edges; of the centres where no axis has a gap."""
    dx = F.greatest(b.x0 - a.x1, a.x0 - b.x1, F.lit(0)).cast("double")
    dy = F.greatest(b.y0 - a.y1, a.y0 - b.y1, F.lit(0)).cast("double")
    cx = (a.x0 + a.x1) / 2.0 - (b.x0 + b.x1) / 2.0
    cy = (a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0
    return F.when((dx == 0) & (dy == 0), F.sqrt(cx * cx + cy * cy)).otherwise(F.sqrt(dx * dx + dy * dy))


def clipped(b: Box, width: Column, height: Column) -> list[Column]:
    """The box within the image; callers drop what has no area left."""
    ends = (F.greatest(b.x0, F.lit(0)), F.greatest(b.y0, F.lit(0)), F.least(b.x1, width), F.least(b.y1, height))
    return [c.alias(n) for c, n in zip(ends, ("x0", "y0", "x1", "y1"))]


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """Corners of a centred box, cut toward zero."""
    ends = (cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)
    return [c.cast("int").alias(n) for c, n in zip(ends, ("x0", "y0", "x1", "y1"))]


def unrotated(b: Box, turn: Column, width: Column, height: Column) -> list[Column]:
    """A box read on a page turned clockwise by `turn` degrees, on the upright page of that width and height."""

    def pick(none: Column, quarter: Column, half: Column, three: Column) -> Column:
        return F.when(turn == 90, quarter).when(turn == 180, half).when(turn == 270, three).otherwise(none)

    return [
        pick(b.x0, b.y0, width - b.x1, width - b.y1).alias("x0"),
        pick(b.y0, height - b.x1, height - b.y1, b.x0).alias("y0"),
        pick(b.x1, b.y1, width - b.x0, width - b.y0).alias("x1"),
        pick(b.y1, height - b.x0, height - b.y0, b.x1).alias("y1"),
    ]


def turned(x: Column, y: Column, w: Column, h: Column, turn: Column) -> tuple[Column, Column]:
    """A point of a w by h picture after a clockwise turn by a multiple of 90 degrees; others raise an error."""
    bad = F.raise_error(F.concat(F.lit("not a quarter turn: "), turn.cast("string"))).cast("int")
    nx = F.when(turn == 0, x).when(turn == 90, h - 1 - y).when(turn == 180, w - 1 - x).when(turn == 270, y).otherwise(bad)
    ny = F.when(turn == 0, y).when(turn == 90, x).when(turn == 180, h - 1 - y).when(turn == 270, w - 1 - x).otherwise(bad)
    return nx, ny


def placed(fraction: Column, start: Column, size: Column) -> Column:
    """A template's fraction on a box, rounded half to even."""
    return start + F.bround(fraction * size, 0).cast("int")


def direction(dx: Column, dy: Column) -> Column:
    """Degrees of a vector; null for the zero vector."""
    return F.when((dx != 0) | (dy != 0), F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))))


def turn_between(a: Column, b: Column) -> Column:
    """The smaller angle between two directions, 0 to 180 degrees."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d <= 180, d).otherwise(360.0 - d)


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and their harmonic mean; 0 on a zero denominator."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def circle_through(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """Centre and radius of the circle through three points by Cramer's rule; null if they're nearly on a line."""
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    m11, m12, v1 = 2 * (bx - ax), 2 * (by - ay), bx * bx + by * by - ax * ax - ay * ay
    m21, m22, v2 = 2 * (cx - ax), 2 * (cy - ay), cx * cx + cy * cy - ax * ax - ay * ay
    det = m11 * m22 - m12 * m21
    ok = F.abs(det) >= 1e-6
    x, y = F.when(ok, (v1 * m22 - m12 * v2) / det), F.when(ok, (m11 * v2 - v1 * m21) / det)
    return x, y, F.sqrt((ax - x) * (ax - x) + (ay - y) * (ay - y))
