"""Symbols from S-expression library files, read whole, and their pictures.

Primitives come out one to a row: symbol, kind (polyline, circle, rectangle, arc, pin), its points,
radius, angle, length and number.  Nested symbols are units of the symbol around them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.operators import raster

_ITEM = re.compile(r'\(|\)|"(?:[^"\\]|\\.)*"|[^\s()"]+')
FIELDS = "symbol string, ord int, kind string, points array<struct<x:double,y:double>>, radius double, angle double, length double, number string"


def parse(text: str) -> list:
    """Nested lists of strings; an unclosed list ends with the text."""
    stack: list[list] = [[]]
    for m in _ITEM.finditer(text):
        item = m[0]
        if item == "(":
            stack.append([])
        elif item == ")":
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
        else:
            stack[-1].append(item[1:-1].replace('\\"', '"') if item[0] == '"' else item)
    while len(stack) > 1:
        done = stack.pop()
        stack[-1].append(done)
    return stack[0]


def children(node: list, tag: str) -> list[list]:
    return [c for c in node[1:] if isinstance(c, list) and c and c[0] == tag]


def number(node: list, tag: str, default: float | None = None) -> float | None:
    found = children(node, tag)
    return float(found[0][1]) if found and len(found[0]) > 1 else default


def point(node: list, tag: str) -> tuple[float, float] | None:
    found = children(node, tag)
    return (float(found[0][1]), float(found[0][2])) if found else None


def primitives(node: list) -> Iterator[tuple]:
    """(kind, points, radius, angle, length, number) of a symbol and its nested units."""
    for c in node[1:]:
        if not isinstance(c, list) or not c:
            continue
        if c[0] == "symbol":
            yield from primitives(c)
        elif c[0] == "polyline":
            yield "polyline", [(float(p[1]), float(p[2])) for pts in children(c, "pts") for p in children(pts, "xy")], None, None, None, None
        elif c[0] == "circle":
            yield "circle", [point(c, "center")], number(c, "radius"), None, None, None
        elif c[0] == "rectangle":
            yield "rectangle", [point(c, "start"), point(c, "end")], None, None, None, None
        elif c[0] == "arc":
            yield "arc", [point(c, "start"), point(c, "mid"), point(c, "end")], None, None, None, None
        elif c[0] == "pin":
            at = children(c, "at")[0]
            named = children(c, "number")
            yield "pin", [(float(at[1]), float(at[2]))], None, float(at[3]) if len(at) > 3 else 0.0, number(c, "length", 0.0), named[0][1] if named else ""


def rows(text: str) -> Iterator[tuple]:
    for library in parse(text):
        if not isinstance(library, list):
            continue
        for s in children(library, "symbol"):
            for k, (kind, points, *rest) in enumerate(primitives(s)):
                yield (s[1], k, kind, [{"x": x, "y": y} for x, y in points], *rest)


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """file and the primitives of every library file under path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    names = ["file", *(x.split(" ")[0] for x in FIELDS.split(", "))]

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, text in zip(frame["file"], frame["value"]):
                yield pd.DataFrame([(file, *row) for row in rows(text or "")], columns=names)

    return files.mapInPandas(make, f"file string, {FIELDS}")


def bounds(primitives: DataFrame, by: list[str]) -> DataFrame:
    """Per symbol the box of all points, circles with their radius and pins with their inner ends; 2.54 around 0 for symbols without points."""
    ends = F.expr("""
        CASE kind
          WHEN 'circle' THEN array(named_struct('x', points[0].x - radius, 'y', points[0].y - radius), named_struct('x', points[0].x + radius, 'y', points[0].y + radius))
          WHEN 'pin' THEN array(points[0], named_struct('x', points[0].x + length * cos(radians(angle)), 'y', points[0].y + length * sin(radians(angle))))
          ELSE points END
    """).cast("array<struct<x:double,y:double>>")
    p = primitives.select(*by, F.explode_outer(ends).alias("p"))
    return p.groupBy(*by).agg(
        F.coalesce(F.min("p.x"), F.lit(-2.54)).alias("x0"), F.coalesce(F.min("p.y"), F.lit(-2.54)).alias("y0"),
        F.coalesce(F.max("p.x"), F.lit(2.54)).alias("x1"), F.coalesce(F.max("p.y"), F.lit(2.54)).alias("y1"),
    )


def terminals(primitives: DataFrame, by: list[str], scale: float = 20.0, margin: int = 12) -> DataFrame:
    """Pins in picture coordinates (y down, cut toward zero): number, x, y of the outer end and body_x, body_y of the inner one."""
    at = primitives.where("kind = 'pin'").join(bounds(primitives, by), by)
    x, y = F.col("points")[0]["x"], F.col("points")[0]["y"]
    bx, by_ = x + F.col("length") * F.cos(F.radians("angle")), y + F.col("length") * F.sin(F.radians("angle"))
    across = lambda v: ((v - F.col("x0")) * scale + margin).cast("int")
    down = lambda v: ((F.col("y1") - v) * scale + margin).cast("int")
    return at.select(*by, "ord", "number", across(x).alias("x"), down(y).alias("y"), across(bx).alias("body_x"), down(by_).alias("body_y"))


def arc_angles(start: tuple[float, float], mid: tuple[float, float], end: tuple[float, float], centre: tuple[float, float]) -> tuple[float, float]:
    """Degrees at which an arc starts and ends, the end beyond the start, so that the middle point lies between."""
    a, m, e = (math.degrees(math.atan2(p[1] - centre[1], p[0] - centre[0])) for p in (start, mid, end))
    if (m - a) % 360 > (e - a) % 360:
        a, e = e, a
    return a, a + (e - a) % 360


def centre(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> tuple[float, float] | None:
    """The middle of the circle through three points; none if they're nearly on a line."""
    m = 2 * np.array([[b[0] - a[0], b[1] - a[1]], [c[0] - a[0], c[1] - a[1]]])
    if abs(np.linalg.det(m)) < 1e-6:
        return None
    square = lambda p: p[0] ** 2 + p[1] ** 2
    x, y = np.linalg.solve(m, [square(b) - square(a), square(c) - square(a)])
    return float(x), float(y)


def drawn(parts: list[tuple], box: tuple[float, float, float, float], scale: float = 20.0, margin: int = 12) -> np.ndarray:
    """A gray picture of primitives (kind, points, radius, angle, length), black on white; box: their bounds x0, y0, x1, y1, y up."""
    x0, y0, x1, y1 = box
    canvas = np.full((max(int((y1 - y0) * scale) + 2 * margin, 20), max(int((x1 - x0) * scale) + 2 * margin, 20)), 255, np.uint8)
    thickness = max(1, int(scale * 0.05))
    on = lambda p: (int((p[0] - x0) * scale) + margin, int((y1 - p[1]) * scale) + margin)
    for kind, points, radius, angle, length in parts:
        at = [on(p) for p in points]
        if kind == "polyline":
            raster.line(canvas, at, thickness)
        elif kind == "circle":
            raster.arc(canvas, *at[0], max(1, int(radius * scale)), thickness)
        elif kind == "rectangle":
            (ax, ay), (bx, by) = at
            raster.line(canvas, [(ax, ay), (bx, ay), (bx, by), (ax, by), (ax, ay)], thickness)
        elif kind == "arc":
            middle = centre(*at)
            if middle is None:
                raster.line(canvas, at, thickness)
            else:
                start, end = arc_angles(*at, middle)
                raster.arc(canvas, *middle, math.dist(middle, at[0]), thickness, start, end)
        elif kind == "pin" and length and length > 0:
            (px, py), a = points[0], math.radians(angle)
            raster.line(canvas, [at[0], on((px + length * math.cos(a), py + length * math.sin(a)))], thickness)
    return canvas


def pictures(primitives: DataFrame, scale: float = 20.0, margin: int = 12) -> DataFrame:
    """(file, symbol, height, width, data): a picture of every symbol, a gray byte a pixel. A symbol's primitives are few."""
    boxed = primitives.join(bounds(primitives, ["file", "symbol"]), ["file", "symbol"])
    part = F.struct("ord", "kind", "points", "radius", "angle", "length")
    each = boxed.groupBy("file", "symbol", "x0", "y0", "x1", "y1").agg(F.sort_array(F.collect_list(part)).alias("parts"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                parts = [(p["kind"], [(q["x"], q["y"]) for q in p["points"]], p["radius"], p["angle"], p["length"]) for p in r.parts]
                picture = drawn(parts, (r.x0, r.y0, r.x1, r.y1), scale, margin)
                out.append((r.file, r.symbol, *picture.shape, picture.tobytes()))
            yield pd.DataFrame(out, columns=["file", "symbol", "height", "width", "data"])

    return each.mapInPandas(make, "file string, symbol string, height int, width int, data binary")
