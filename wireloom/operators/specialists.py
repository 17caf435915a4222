"""Specialists for classes that look alike: shape facts of a crop, and rules over them.

A crop's facts come from its pixels; the rules are expressions, so they can be read, tested and
changed without pictures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.operators import raster

#: Pixels in a row that a plate has at least.
PLATE = 14
FACTS = "plates int, curved boolean, plus boolean, circle boolean, rectangle boolean"


def plates(mask: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
    """(y0, y1, x0, x1, curved) of plates, from the top: rows with a long run, and wide sparse bows that overlap none of them."""
    longest = [max(raster.runs(row), key=lambda r: r[1] - r[0], default=(0, -1)) for row in mask]
    rows = np.array([b - a + 1 >= PLATE for a, b in longest])
    flat = []
    for a, b in raster.runs(rows):
        part = longest[a : b + 1]
        flat.append((a, b + 1, min(p[0] for p in part), max(p[1] for p in part), False))
    bows = []
    for x0, y0, x1, y1, area in raster.stats(raster.labels(mask)):
        w, h = x1 - x0, y1 - y0
        if w >= PLATE and 6 <= h <= 0.5 * mask.shape[0] and area / (w * h) < 0.4 and all(y1 <= f[0] or y0 >= f[1] for f in flat):
            bows.append((y0, y1, x0, x1, True))
    return sorted([*flat, *bows], key=lambda p: p[0])


def plus(mask: np.ndarray) -> bool:
    """Whether a small squarish component has ink along its middle row and column and little in its corners."""
    height, width = mask.shape
    for x0, y0, x1, y1, _ in raster.stats(raster.labels(mask)):
        w, h = x1 - x0, y1 - y0
        if min(w, h) < 4 or w > 0.4 * width or h > 0.4 * height or abs(w - h) > 0.6 * max(w, h):
            continue
        part = mask[y0:y1, x0:x1]
        row, column = part[max(0, h // 2 - 1) : h // 2 + 2].sum(), part[:, max(0, w // 2 - 1) : w // 2 + 2].sum()
        c = max(1, min(w, h) // 4)
        corners = sum(q.sum() for q in (part[:c, :c], part[:c, -c:], part[-c:, :c], part[-c:, -c:]))
        if row and column and corners < 0.3 * (row + column):
            return True
    return False


def facts(picture: np.ndarray | None) -> dict | None:
    """plates, curved, plus of a gray crop, turned upright if it lies; null for crops under 10 pixels."""
    if picture is None or min(picture.shape) < 10:
        return None
    mask = picture <= raster.otsu(picture)
    if mask.shape[1] > 1.3 * mask.shape[0]:
        mask = np.rot90(mask, -1)
    found = plates(mask)
    return {"plates": len(found), "curved": any(p[4] for p in found[:2]), "plus": plus(mask)}


def shapes(picture: np.ndarray | None) -> dict | None:
    """Whether a gray crop holds a circle or an upright rectangle; null for crops under 12 pixels."""
    if picture is None or min(picture.shape) < 12:
        return None
    mask = picture <= raster.otsu(picture)
    return {"circle": raster.circle(mask) is not None, "rectangle": raster.rectangular(mask)}


def transistor(picture: np.ndarray | None) -> tuple[str, float] | None:
    """Class and confidence of a transistor's kind: its arrowhead's tip points away from its circle's middle, or toward it.

    No group is routed here: on drawings as scanned the arrowhead is too coarse to be told well.
    """
    if picture is None or min(picture.shape) < 12:
        return None
    mask = picture <= raster.otsu(picture)
    ring = raster.circle(mask)
    if ring is None or (head := raster.arrowhead(mask, ring)) is None:
        return None
    middle, centre = head.mean(axis=0), np.array(ring[:2], float)
    tip = head[np.argmax(((head - middle) ** 2).sum(axis=1))]
    away = ((tip - centre) ** 2).sum() > ((middle - centre) ** 2).sum()
    return ("BJT_NPN" if away else "BJT_PNP"), 0.6


def battery_or_capacitor(n: Column, curved: Column, has_plus: Column) -> Column:
    """struct(class, confidence) by plates, bow and plus mark; null for fewer than two plates."""
    say = lambda c, p: F.struct(F.lit(c).alias("class"), F.lit(p).alias("confidence"))
    return F.when(n >= 4, say("Battery", 0.85)).when((n >= 2) & curved, say("Capacitor_Polarized", 0.7)).when((n >= 2) & has_plus, say("Battery", 0.55)).when(n >= 2, say("Capacitor", 0.6))


def transistor_or_potentiometer(circle: Column, rectangle: Column) -> Column:
    """array of struct(class, score, confidence): a circle says a transistor of either kind, a rectangle a potentiometer; else null."""
    say = lambda c, s, p: F.struct(F.lit(c).alias("class"), F.lit(s).alias("score"), F.lit(p).alias("confidence"))
    return F.when(circle, F.array(say("BJT_NPN", 0.5, 0.75), say("BJT_PNP", 0.5, 0.75))).when(rectangle, F.array(say("Potentiometer", 1.0, 0.6)))


def shape_facts(crops: DataFrame) -> DataFrame:
    """Adds the facts to crops (height, width, data: one gray byte a pixel); a column per fact, null where there are none."""
    names = [x.split()[0] for x in FACTS.split(", ")]

    @F.pandas_udf(FACTS)
    def read(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.DataFrame:
        crops = [np.frombuffer(d, np.uint8).reshape(a, b) if d is not None else None for a, b, d in zip(h, w, data)]
        rows = [dict.fromkeys(names) | (facts(c) or {}) | (shapes(c) or {}) for c in crops]
        return pd.DataFrame(rows, columns=names).astype({n: "Int32" if n == "plates" else "boolean" for n in names})

    return crops.withColumn("f", read("height", "width", "data")).select("*", "f.*").drop("f")


def single(said: Column) -> Column:
    """struct(class, confidence) as an array of struct(class, score, confidence); null stays null."""
    return F.when(said.isNotNull(), F.array(F.struct(said["class"].alias("class"), F.lit(1.0).alias("score"), said["confidence"].cast("double").alias("confidence"))))


#: What a named specialist says, as expressions over the facts.
SAYS = {
    "battery_capacitor": lambda: single(battery_or_capacitor(F.col("plates"), F.col("curved"), F.col("plus"))),
    "bjt_potentiometer": lambda: transistor_or_potentiometer(F.col("circle"), F.col("rectangle")),
}


def opinions(crops: DataFrame, routes: DataFrame, by: list[str], source_ord: int = 4, says: dict | None = None) -> DataFrame:
    """Evidence (by..., source, source_ord, class_ord, class, score, confidence) of the specialists that candidates are routed to.

    crops: by..., height, width, data; routes: by..., route, a specialist's name.  Others, and specialists that
    say nothing, give no rows.  says: further specialists by name, each a function to such an array.
    """
    read = shape_facts(crops.join(routes, by))
    said = F.lit(None).cast("array<struct<class:string,score:double,confidence:double>>")
    for name, rule in (SAYS | (says or {})).items():
        said = F.when(F.col("route") == name, rule()).otherwise(said)
    each = read.select(*by, F.concat(F.lit("geometry:"), "route").alias("source"), F.posexplode(said).alias("class_ord", "e"))
    return each.select(*by, "source", F.lit(source_ord).alias("source_ord"), "class_ord", "e.class", "e.score", "e.confidence")
