"""Reference pictures and their embeddings, kept until the files or the model change."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions.geometry import turned
from wireloom.operators import raster

TURNS = (0, 90, 180, 270)


def files(spark: SparkSession, path: str) -> DataFrame:
    """class (the folder's name), file, size and time of each picture <class>/*.png under path; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("time"))


def signature(found: DataFrame, model: str) -> str:
    """A digest of all files' names, sizes and times, in order, and of the model: digests of buckets of some thousand files, then one of those."""
    line = F.concat_ws("|", "file", F.col("size").cast("string"), F.col("time").cast("string"))
    bucket = F.pmod(F.xxhash64("file"), F.lit(max(256, found.count() >> 12)))
    each = found.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("d"))
    whole = F.sha2(F.concat(F.lit(model), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n")), 256)
    return each.agg(whole.alias("s")).first().s


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists and holds a finished table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, path: str, current: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was written under this signature, else build()'s, written there."""
    if there(spark, path):
        held = spark.read.parquet(path)
        if "signature" in held.columns and held.select("signature").limit(1).collect() == [(current,)]:
            return held.drop("signature")
    build().withColumn("signature", F.lit(current)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("signature")


def entries(spark: SparkSession, path: str, embed: Callable, turns: tuple = TURNS, mirror: bool = True) -> DataFrame:
    """(class, file, entry, turn, mirrored, v): each reference picture <class>/*.png in its variants, embedded. entry is the file and its variant."""
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    some = read.select(F.regexp_extract("image.origin", r"([^/]+)/[^/]+$", 1).alias("class"), F.regexp_extract("image.origin", r"([^/]+/[^/]+)$", 1).alias("file"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")

    def make(frames):
        for frame in frames:
            rows, squares = [], []
            for r in frame.rename(columns={"class": "kind"}).itertuples():
                picture = raster.gray(bytes(r.data), r.height, r.width, r.channels)
                for turn, mirrored, variant in raster.variants(picture, turns, mirror):
                    rows.append((r.kind, r.file, f"{r.file}|{int(mirrored)}|{turn:03d}", turn, mirrored))
                    squares.append(raster.square(variant))
            if rows:
                v = np.asarray(embed(squares), dtype=float)
                v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
                yield pd.DataFrame(rows, columns=["class", "file", "entry", "turn", "mirrored"]).assign(v=list(v))

    return some.mapInPandas(make, "class string, file string, entry string, turn int, mirrored boolean, v array<double>")


def built(spark: SparkSession, path: str, cache: str, embed: Callable, model: str, turns: tuple = TURNS, mirror: bool = True) -> DataFrame:
    """entries(), from the cache while neither files nor the model nor the variants have changed."""
    current = signature(files(spark, path), f"{model}|{sorted(turns)}|{mirror}")
    return cached(spark, cache, current, lambda: entries(spark, path, embed, turns, mirror))


def templates(terminals: DataFrame, pictures: DataFrame) -> DataFrame:
    """Terminals as fractions of each of eight variants: class, name, turn, mirrored, idx, terminal, tx, ty, bx, by.

    terminals are as of sources.drawings.sidecars; pictures holds class, name, width, height.
    """
    ways = F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(m).alias("mirrored")) for m in (False, True) for t in TURNS])
    each = terminals.join(pictures, ["class", "name"]).withColumn("v", F.explode(ways)).select("*", "v.*")
    w, h, turn = F.col("width"), F.col("height"), F.col("turn")
    flip = lambda c: F.when(F.col("mirrored"), w - 1 - c).otherwise(c)
    lies = turn.isin(90, 270)
    vw, vh = F.when(lies, h).otherwise(w), F.when(lies, w).otherwise(h)
    tip, body = (turned(flip(F.col(x)), F.col(y), w, h, turn) for x, y in (("x", "y"), ("body_x", "body_y")))
    ends = [(c / s).alias(n) for (c, s, n) in ((tip[0], vw, "tx"), (tip[1], vh, "ty"), (body[0], vw, "bx"), (body[1], vh, "by"))]
    return each.select("class", "name", "turn", "mirrored", "idx", "terminal", *ends)


def ends(spark: SparkSession, path: str) -> DataFrame:
    """(entry, k, name, tx, ty, bx, by): the terminals of all variants of the pictures under path that have them, by entries()' entry."""
    from wireloom.sources import drawings

    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    sizes = read.select(F.regexp_extract("image.origin", r"([^/]+)/[^/]+$", 1).alias("class"), drawings.stem(F.col("image.origin")).alias("name"), "image.width", "image.height")
    found = templates(drawings.sidecars(spark, path), sizes)
    entry = F.concat_ws("|", F.concat("class", F.lit("/"), "name", F.lit(".png")), F.col("mirrored").cast("int").cast("string"), F.lpad(F.col("turn").cast("string"), 3, "0"))
    return found.select(entry.alias("entry"), F.col("idx").alias("k"), F.col("terminal").alias("name"), "tx", "ty", "bx", "by")
