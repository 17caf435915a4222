"""Toxicity categories by a classifier chain.

Each category has a linear model over hashed words and beginnings of words (stems with endings).  Later models also see the
probabilities of the earlier categories; in training these are out-of-fold predictions, so a
later model learns from probabilities as they will be on unseen text.  The tables' only
toxicity label is `toxic`, which ends the chain; the categories before it are the KINDS clusters of the toxic
labelled rows by the buckets that set them apart from the others (spherical k-means), so they follow the corpus's own vocabulary
and languages.  Every model is fitted on a bounded sample (SAMPLE) of labelled rows and
broadcast (a weight for each bucket
that separates the classes, at most the sample's words); scoring is one pass in Arrow batches without a shuffle.

Defined results: a null or empty text has no n-grams and is never toxic; without
labelled rows, or with one class, all probabilities are the class's (0 without rows); a cluster without rows has
probability 0; repeated rows give repeated results; an empty table gives no rows; texts of any length are
read whole, long ones in pieces with the same result; other columns are neither read nor returned by judge() and kept by drop().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wireloom.llm.features import Grams, Rows, folds, platt, present, sigmoid
from wireloom.llm.sample import labelled

#: Labelled rows that the chain is fitted on, at most.
SAMPLE = 4000
#: A document is toxic from this probability of the last category on.
TOXIC = 0.15
#: Buckets whose share of rows differs less between the classes, in standard errors, get no weight.
LEAST_Z = 4.0
#: Steps of a fit.
STEPS = 200
SPEC = Grams(words=(1,), chars=(), bits=40, starts=(3, 4, 5, 6), letters=True, presence=True)
#: Clusters of the toxic rows.
KINDS = 2
CHAIN = [*(f"kind_{k}" for k in range(1, KINDS + 1)), "toxic"]


@dataclass
class Chain:
    """Buckets with a weight, their weights by category, and per category the weights of the earlier probabilities, bias and Platt's two numbers; or one constant."""

    buckets: np.ndarray
    weights: np.ndarray
    links: list[tuple[np.ndarray, float, float, float] | float]

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        z = present(texts, SPEC, self.buckets, self.weights)
        out = np.zeros((len(texts), len(self.links)))
        for k, link in enumerate(self.links):
            if isinstance(link, float):
                out[:, k] = link
            else:
                earlier, bias, slope, shift = link
                out[:, k] = sigmoid(slope * (z[:, k] + out[:, :k] @ earlier + bias) + shift)
        return np.where(np.array([not (t and t.strip()) for t in texts])[:, None], 0.0, out) if texts else out


def kinds(rows: Rows, toxic: np.ndarray, k: int = KINDS, rounds: int = 20) -> list[np.ndarray]:
    """The toxic rows in k clusters by cosine over the buckets that more of them hold than of the others; ties and empty rows go to the first."""
    some = np.flatnonzero(toxic)
    if not len(some) or len(some) == rows.n:
        return [toxic & False for _ in range(k)]
    telling = rows.differs(toxic.astype(int), np.ones(rows.n, bool)) >= LEAST_Z
    use = telling[rows.col] & toxic[rows.row]
    row, col = rows.row[use], rows.col[use]
    size = np.sqrt(np.maximum(np.bincount(row, minlength=rows.n), 1))
    near = lambda center: np.bincount(row, weights=center[col], minlength=rows.n) / size
    unit = lambda v: v / max(float(np.sqrt((v * v).sum())), 1e-12)
    of = lambda who: unit(np.bincount(col, weights=(who / size)[row], minlength=rows.width))
    # the first center is the largest row, each next one the row least like those before
    picked = [some[np.argmax(size[some])]]
    centers = [of(np.arange(rows.n) == picked[0])]
    while len(centers) < k:
        picked.append(some[np.argmin(np.max([near(c)[some] for c in centers], axis=0))])
        centers.append(of(np.arange(rows.n) == picked[-1]))
    at = None
    for _ in range(rounds):
        now = np.argmax([near(c) for c in centers], axis=0)
        if at is not None and (now == at).all():
            break
        at = now
        centers = [of(toxic & (at == j)) for j in range(k)]
    return [toxic & (at == j) for j in range(k)]


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    _, at, value, y = labelled(documents, labels, "toxic", SPEC, sample)
    return fit(Rows(at, value), y > 0)


def fit(rows: Rows, toxic: np.ndarray) -> Chain:
    targets = [*kinds(rows, toxic), toxic]
    everyone = np.arange(rows.n)
    earlier = np.zeros((rows.n, 0))
    links: list = []
    weights = np.zeros((rows.width, len(targets)))
    for target in targets:
        y = target.astype(int)
        if len(np.unique(y)) < 2:
            links.append(float(y.mean()) if len(y) else 0.0)
            earlier = np.column_stack((earlier, np.full(rows.n, links[-1])))
            continue
        out = np.zeros(rows.n)
        for held in folds(y):
            out[held] = rows.logits(*rows.fit(y, np.setdiff1d(everyone, held), earlier, steps=STEPS, least_z=LEAST_Z), earlier)[held]
        slope, shift = platt(out, y)
        w, u, bias = rows.fit(y, everyone, earlier, steps=STEPS, least_z=LEAST_Z)
        weights[:, len(links)] = w
        links.append((u, bias, slope, shift))
        earlier = np.column_stack((earlier, sigmoid(slope * out + shift)))
    used = weights.any(axis=1)
    return Chain(rows.buckets[used], weights[used], links)


def judge(documents: DataFrame, chain: Chain, threshold: float = TOXIC) -> DataFrame:
    """doc_id, a probability per category and the verdict, for every row."""
    held = documents.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *(f"p_{c}" for c in CHAIN), "toxic"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.probabilities(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, p.T), pa.array(p[:, -1] >= threshold)], names=names)

    return documents.select("doc_id", "text").mapInArrow(make, f"doc_id long, {', '.join(f'p_{c} double' for c in CHAIN)}, toxic boolean")


def drop(documents: DataFrame, chain: Chain, threshold: float = TOXIC) -> DataFrame:
    """The rows that judge() doesn't find toxic, with all their columns."""
    held = documents.sparkSession.sparkContext.broadcast(chain)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.probabilities(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(p[:, -1] < threshold))

    return documents.mapInArrow(make, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
