"""What readers and detectors give, as clean rows; and a cache of their answers.

The readers themselves (text recognition, detectors) are outside; their raw rows come in as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.geometry import Box, clipped, from_center, unrotated


def tokens(raw: DataFrame, scale: int = 3) -> DataFrame:
    """(drawing_id, ord, text, x0..y1, confidence, orientation) of raw readings.

    raw: drawing_id, ord, text, conf (text, perhaps no number), left, top, width, height, orientation, and the upright page's
    page_width and page_height, all on a page enlarged `scale` times.  Blank texts, and confidences that are negative or no number, go.
    """
    sure = F.coalesce(F.expr("try_cast(conf AS double)"), F.lit(-1.0))
    read = raw.withColumn("text", F.trim("text")).withColumn("confidence", sure / 100).where((F.col("text") != "") & (F.col("confidence") >= 0))
    boxed = read.select("*", F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))
    upright = boxed.select("drawing_id", "ord", "text", *unrotated(Box(), F.col("orientation"), F.col("page_width"), F.col("page_height")), "confidence", "orientation")
    return upright.select("drawing_id", "ord", "text", *[F.floor(F.col(c) / scale).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], "confidence", "orientation")


def detections(raw: DataFrame, least: float = 0.0) -> DataFrame:
    """raw detections (x, y of the centre, width, height, confidence, page_width, page_height) as boxes within the page; boxes without area go."""
    sure = raw.where(F.col("confidence") >= least)
    keep = [c for c in raw.columns if c not in ("x", "y", "width", "height")]
    cut = sure.select(*keep, *from_center(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
    inside = cut.select(*keep, *clipped(Box(), F.col("page_width"), F.col("page_height")))
    return inside.where("x1 > x0 and y1 > y0")


def key(content: Column, model: str, settings: str) -> Column:
    """The name under which an answer about this content is kept: 16 digits of a SHA-1."""
    return F.substring(F.sha1(F.concat_ws("|", content.cast("string"), F.lit(model), F.lit(settings))), 1, 16)


def unanswered(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """The rows of asked whose key the cache doesn't hold, one a key."""
    return asked.dropDuplicates(["key"]).join(cache.select("key").distinct(), "key", "left_anti")
