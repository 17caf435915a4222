"""Greedy one-to-one matching, and merging of boxes.

Pairs are sorted by drawing and order, and taken in one pass over the sorted partitions: a task remembers which sides
of the drawing it is at are taken, and no more.  A drawing is one sheet, so its pairs come to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy(pairs: DataFrame, left: list[str], right: list[str], order: list) -> DataFrame:
    """The accepted rows of pairs, in a total order (ascending columns) each whose both sides are still free.

    left and right name the columns of the two sides; those in both (the drawing) part the pairs into groups.
    """
    by = [c for c in left if c in right]
    sides = [[c for c in side if c not in by] for side in (left, right)]
    marked = pairs.select("*", *[c.alias(f"_order{k}") for k, c in enumerate(order)])
    keys, names = [f"_order{k}" for k in range(len(order))], pairs.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, (set(), set())
        for batch in batches:
            rows = [list(zip(*(batch.column(c).to_pylist() for c in columns))) if columns else [()] * batch.num_rows for columns in (by, *sides)]
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (group, a, b) in enumerate(zip(*rows)):
                if group != at:
                    at, taken = group, (set(), set())
                if a not in taken[0] and b not in taken[1]:
                    keep[k] = True
                    taken[0].add(a)
                    taken[1].add(b)
            yield batch.select(names).filter(pa.array(keep))

    dealt = marked.repartition(*by) if by else marked.coalesce(1)
    return dealt.sortWithinPartitions(*by, *keys).mapInArrow(make, pairs.schema)


def merge_boxes(boxes: list[dict], least: float) -> list[dict]:
    """Order-dependent merge of one drawing's boxes until no two overlap by `least` of the smaller.

    The first pair in order is joined in the earlier place: the union box, the higher confidence
    (missing ones lowest, ties keep the earlier) and its source, class and confidence of the one that
    has a class (both: the more confident), its kind, or 'ambiguous' if kinds differ, and a composite source
    if the two are exactly the synthetic and the real detector.

    After a merge only pairs with the grown box can be new; so the first pair is one of an earlier box with it, else one of
    it with a later box, and each merge looks at each box once.
    """
    boxes = [dict(b) for b in boxes]
    at = np.array([[b[c] for c in ("x0", "y0", "x1", "y1")] for b in boxes], dtype=float).reshape(-1, 4)
    live = np.ones(len(boxes), dtype=bool)

    def first(i: int, low: int, high: int) -> int | None:
        """The first box from low to high that overlaps box i."""
        part = at[low:high]
        w, h = (np.minimum(part[:, k + 2], at[i, k + 2]) - np.maximum(part[:, k], at[i, k]) for k in (0, 1))
        smaller = np.minimum((part[:, 2] - part[:, 0]) * (part[:, 3] - part[:, 1]), (at[i, 2] - at[i, 0]) * (at[i, 3] - at[i, 1]))
        met = np.flatnonzero(live[low:high] & (w > 0) & (h > 0) & (smaller > 0) & (w * h / np.where(smaller > 0, smaller, 1) >= least))
        return low + int(met[0]) if len(met) else None

    def join(i: int, j: int) -> None:
        a, b = boxes[i], boxes[j]
        sure = lambda p: -1.0 if p["confidence"] is None else p["confidence"]
        better = a if sure(a) >= sure(b) else b
        named = next((p for p in (better, a, b) if p["class"] is not None), better)
        sources = {a["source"], b["source"]}
        boxes[i] = {
            **a,
            "x0": min(a["x0"], b["x0"]), "y0": min(a["y0"], b["y0"]), "x1": max(a["x1"], b["x1"]), "y1": max(a["y1"], b["y1"]),
            "kind": a["kind"] if a["kind"] == b["kind"] else "ambiguous",
            "class": named["class"],
            "confidence": named["confidence"],
            "source": "synthetic_yolo+real_detector" if sources == {"synthetic_yolo", "real_detector"} else better["source"],
        }
        at[i] = [boxes[i][c] for c in ("x0", "y0", "x1", "y1")]
        live[j] = False

    i = 0
    while i < len(boxes):
        if not live[i] or (j := first(i, i + 1, len(boxes))) is None:
            i += 1
            continue
        join(i, j)
        while (k := first(i, 0, i)) is not None:
            join(k, i)
            i = k
    return [b for b, there in zip(boxes, live) if there]


def merged(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes (drawing_id, idx, x0..y1, kind, class, confidence, source) merged per drawing in idx order; a drawing is one sheet."""
    names = ["drawing_id", "idx", "x0", "y0", "x1", "y1", "kind", "class", "confidence", "source"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["drawing_id"] != row["drawing_id"]:
                    out += [{**r, "idx": k} for k, r in enumerate(merge_boxes(held, least))]
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
            schema = batch.schema
        if held:
            yield pa.RecordBatch.from_pylist([{**r, "idx": k} for k, r in enumerate(merge_boxes(held, least))], schema=schema)

    rows = boxes.select(names)
    # one pass over sorted partitions; a task holds one drawing at a time
    return rows.repartition("drawing_id").sortWithinPartitions("drawing_id", "idx").mapInArrow(make, rows.schema)
