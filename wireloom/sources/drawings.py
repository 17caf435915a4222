"""Readers of golden drawings, predictions, terminal sidecars and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = "array<struct<id:string,type:string,coordinates:array<int>,connections:array<string>,note:string>>"
GOLDEN = f"_notes string, _connectivity_verified boolean, symbols {SYMBOLS}, _excluded_false_positives array<struct<id:string,coordinates:array<int>,reason:string>>"
SIDECAR = "name string, point array<int>, body array<int>"


def stem(path: Column) -> Column:
    """A file's name without folder and last ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def drawings(spark: SparkSession, path: str) -> DataFrame:
    """Golden or predicted drawings (JSON, one file each): drawing_id, verified, symbols. Both optional fields have defaults."""
    read = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    return read.select(stem(F.col("_metadata.file_path")).alias("drawing_id"), F.coalesce("_connectivity_verified", F.lit(False)).alias("verified"), F.coalesce("symbols", F.array().cast(SYMBOLS)).alias("symbols"))


def symbols(read: DataFrame) -> DataFrame:
    """drawings() as rows: drawing_id, verified, idx, id, type, x0..y1, connections (empty if none are given)."""
    one = read.select("drawing_id", "verified", F.posexplode("symbols").alias("idx", "s"))
    box = [F.col("s.coordinates")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return one.select("drawing_id", "verified", "idx", "s.id", "s.type", *box, F.coalesce("s.connections", F.array().cast("array<string>")).alias("connections"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Terminals of reference pictures (<class>/<name>.terminals.json under path): class, name, idx, terminal, x, y, body_x, body_y.

    A missing body is the point itself.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.terminals.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<struct<name:string,point:array<int>,body:array<int>>>").alias("t"))
    one = read.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("class"), F.regexp_replace(stem(F.col("file")), r"\.terminals$", "").alias("name"), F.posexplode("t").alias("idx", "t"))
    body = F.coalesce("t.body", "t.point")
    return one.select("class", "name", "idx", F.col("t.name").alias("terminal"), F.col("t.point")[0].alias("x"), F.col("t.point")[1].alias("y"), body[0].alias("body_x"), body[1].alias("body_y"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures by Spark's image source: drawing_id, height, width, channels, data (rows of blue, green, red)."""
    read = spark.read.format("image").option("dropInvalid", True).load(path)
    return read.select(stem(F.col("image.origin")).alias("drawing_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
