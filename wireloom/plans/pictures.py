"""From pictures to boxes, crops, wire pixels and nets; each picture is one row and is worked on by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.config import Config
from wireloom.operators import graph, raster

BOXES = "drawing_id string, idx int, x0 int, y0 int, x1 int, y1 int, kind string, class string, confidence double, source string"
PIXELS = "drawing_id string, y int, x int"
TERMINALS = "drawing_id string, symbol_id int, idx int, name string, x int, y int, source string, direction_deg double"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def gray(row) -> np.ndarray:
    return raster.gray(bytes(row.data), row.height, row.width, row.channels)


def inked(row, c: Config) -> np.ndarray:
    """A picture's ink, without specks and made level, as the settings say."""
    mask = raster.ink(gray(row), c.binarize_block, c.binarize_offset)
    if c.denoise:
        mask = raster.without_speckles(mask, c.speckle_area)
    return raster.deskewed(mask, c.deskew_most_degrees)[0]


def beside(images: DataFrame, boxes: DataFrame, name: str, *more: str) -> DataFrame:
    """images with the list of a drawing's boxes; a drawing is one sheet."""
    listed = boxes.groupBy("drawing_id").agg(F.sort_array(F.collect_list(F.struct(*more, "x0", "y0", "x1", "y1"))).alias(name))
    return images.join(listed, "drawing_id", "left")


def boxes(images: DataFrame, c: Config = Config(), detect: Callable | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Candidate boxes per image. detect(gray picture) gives dicts of x0..y1, kind, class, confidence, source; without it
    the density of skeleton corners proposes boxes, where the boxes of tokens (drawing_id, x0..y1) and junction dots are erased."""
    given = images.withColumn("texts", F.lit(None).cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")) if tokens is None else beside(images, tokens, "texts")

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                if detect:
                    found = detect(gray(row))
                else:
                    mask = inked(row, c)
                    texts = [] if row.texts is None else [(t["x0"], t["y0"], t["x1"], t["y1"]) for t in row.texts]
                    found = raster.proposals(mask, texts, raster.dots(mask, c.dot_radius, c.dot_fill), c)
                out += [{"drawing_id": row.drawing_id, "idx": k, **b} for k, b in enumerate(found)]
            yield pd.DataFrame(out, columns=names(BOXES))

    return given.mapInPandas(make, BOXES)


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(drawing_id, idx, height, width, data): the gray part of its picture in each box, a byte a pixel; boxes outside give no row."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                picture = gray(row)
                for b in row.boxes:
                    part = raster.crop(picture, b["x0"], b["y0"], b["x1"], b["y1"])
                    if part.size:
                        out.append((row.drawing_id, b["idx"], *part.shape, part.tobytes()))
            yield pd.DataFrame(out, columns=["drawing_id", "idx", "height", "width", "data"])

    some = beside(images, boxes, "boxes", "idx").where("boxes is not null")
    return some.mapInPandas(make, "drawing_id string, idx int, height int, width int, data binary")


def vectors(crops: DataFrame, embed: Callable[[list[np.ndarray]], np.ndarray], *by: str) -> DataFrame:
    """(by..., v): crops in the middle of white squares, as an injected model embeds a list of them, of length 1."""
    by = by or ("drawing_id", "idx")
    kinds = dict(crops.dtypes)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                squares = [raster.square(np.frombuffer(d, np.uint8).reshape(h, w)) for h, w, d in zip(frame["height"], frame["width"], frame["data"])]
                v = np.asarray(embed(squares), dtype=float)
                v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
                yield frame[list(by)].assign(v=list(v))

    return crops.mapInPandas(make, ", ".join(f"{c} {kinds[c]}" for c in by) + ", v array<double>")


def wire_pixels(images: DataFrame, symbols: DataFrame, c: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Skeleton pixels of the wires between symbols (drawing_id, x0..y1), and junction dots, both (drawing_id, y, x)."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                mask = inked(row, c)
                held = [] if row.boxes is None else [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in row.boxes]
                ys, xs = raster.skeleton(raster.wires(mask, held)).nonzero()
                out += [(row.drawing_id, int(y), int(x), False) for y, x in zip(ys, xs)]
                out += [(row.drawing_id, y, x, True) for x, y in raster.dots(mask, c.dot_radius, c.dot_fill)]
            yield pd.DataFrame(out, columns=["drawing_id", "y", "x", "dot"])

    found = beside(images, symbols, "boxes").mapInPandas(make, PIXELS + ", dot boolean")
    return found.where("not dot").drop("dot"), found.where("dot").drop("dot")


def refined(images: DataFrame, symbols: DataFrame, terminals: DataFrame, c: Config = Config()) -> DataFrame:
    """Terminals (TERMINALS) of symbols (drawing_id, idx, x0..y1) moved to where ink reaches their boxes, in order; what is left over there becomes terminals."""
    ends = terminals.groupBy("drawing_id", F.col("symbol_id").alias("idx")).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("k"), "name", "x", "y", "source", "direction_deg"))).alias("ends"))
    some = symbols.select("drawing_id", "idx", "x0", "y0", "x1", "y1").join(ends, ["drawing_id", "idx"], "left")
    listed = some.groupBy("drawing_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x0", "y0", "x1", "y1", "ends"))).alias("boxes"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                mask = inked(row, c)
                for b in row.boxes:
                    own = [] if b["ends"] is None else [{n: t[n] for n in ("name", "x", "y", "source", "direction_deg")} | {"idx": t["k"]} for t in b["ends"]]
                    points = raster.attachments(mask, b["x0"], b["y0"], b["x1"], b["y1"])
                    out += [{"drawing_id": row.drawing_id, "symbol_id": b["idx"], **t} for t in raster.refined(own, points)]
            yield pd.DataFrame(out, columns=names(TERMINALS))

    return images.join(listed, "drawing_id").mapInPandas(make, TERMINALS)


def nets(images: DataFrame, symbols: DataFrame, c: Config = Config()) -> DataFrame:
    """(drawing_id, net_ord, net_id, node) of each picture's wires."""
    pixels, spots = wire_pixels(images, symbols, c)
    return graph.nets(graph.rewired(pixels, spots))


RAW = "drawing_id string, ord int, text string, conf string, left int, top int, width int, height int, orientation int, page_width int, page_height int"


def read(images: DataFrame, reader: Callable[[np.ndarray, str], list[dict]], c: Config = Config()) -> DataFrame:
    """Readings as sources.readings.tokens gives them: an injected reader is asked for each picture, enlarged, in each turn and mode.

    reader(gray picture, mode) gives dicts of text, conf, left, top, width, height.  Nothing is deduplicated, as no mode reads best everywhere.
    """
    from wireloom.sources import readings

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                large, n = raster.enlarged(gray(row), c.reading_scale), 0
                h, w = large.shape
                for turn in c.reading_turns:
                    page = np.ascontiguousarray(np.rot90(large, -turn // 90))
                    for mode in c.reading_modes:
                        for r in reader(page, mode):
                            out.append((row.drawing_id, n, r["text"], str(r["conf"]), r["left"], r["top"], r["width"], r["height"], turn, w, h))
                            n += 1
            yield pd.DataFrame(out, columns=names(RAW))

    return readings.tokens(images.mapInPandas(make, RAW), c.reading_scale)
