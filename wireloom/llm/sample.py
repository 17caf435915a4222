"""A bounded sample of labelled rows, as hashed features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.features import Grams, sparse


def labelled(documents: DataFrame, labels: DataFrame, label: str, spec: Grams, rows: int):
    """At most `rows` labelled documents, first by a hash of their id: (ids, features, label values).

    labels may repeat an id (the largest label counts), hold null ids or labels (skipped), or ids
    without a document (skipped before the first are chosen).  A repeated document id counts once, with the
    least of its texts (by bytes; null if all are).  Texts of any length are featurised whole.  Empty tables give no rows.
    """
    few = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    few = few.join(documents.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    kind = np.int32 if spec.bits < 32 else np.int64
    # `rows` bounds the broadcast side, ids and labels only, and, after the aggregate, what is collected
    texts = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, y, t in zip(*(c.to_pylist() for c in batch.columns)):
                at, value = sparse(t, spec)
                at = at.astype(kind)
                out.append({"doc_id": i, "y": y, "at": at.tobytes(), "value": value.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    found = texts.mapInArrow(make, "doc_id long, y int, at binary, value binary").collect()
    found.sort(key=lambda r: r.doc_id)
    ids = np.array([r.doc_id for r in found], dtype=np.int64)
    at = [np.frombuffer(r.at, kind) for r in found]
    value = [np.frombuffer(r.value, np.float32) for r in found]
    return ids, at, value, np.array([r.y for r in found], dtype=np.int64)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("at", pa.binary()), ("value", pa.binary())])
