"""Quality rules: counted rules and a calibrated hashed n-gram classifier.

The classifier is a logistic regression over hashed word and character n-grams.  It is fitted on
a bounded sample of labelled rows (SAMPLE), calibrated on out-of-fold scores by Platt's method,
broadcast as one table of 2**bits weights, and applied in Arrow batches against a fixed
probability.  One pass over the texts, no shuffle.

Defined results: a null text counts as empty (all counts 0, base_failed, not kept); without
labelled rows, or with one class only, the classifier keeps what the rules keep; rows are
judged one by one, so repeated rows give repeated results; an empty table gives no rows; texts of any length are
counted and scored whole, long ones in pieces with the same result; other columns are neither read nor returned by
judge() and kept by keep().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wireloom.llm.features import Grams, Rows, folds, platt, score, sigmoid
from wireloom.llm.sample import labelled

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 3000
#: Documents whose probability of good quality is lower are rejected.
KEEP = 0.5
#: Characters from which a text's words are numbered, so that its windows take no objects.
LONG = 1 << 22
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPEC = Grams(words=(1, 2), chars=(3,), bits=18)
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def probability(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = score(texts, SPEC, [self.table])[:, 0] + self.bias
        return sigmoid(self.slope * z + self.shift)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    _, at, value, y = labelled(documents, labels, "quality", SPEC, sample)
    y = (y > 0).astype(int)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1), 0.0, 1.0, 0.0, 1.0)
    rows = Rows(at, value)
    none = np.zeros((rows.n, 0))
    out = np.zeros(rows.n)
    for held in folds(y):
        rest = np.setdiff1d(np.arange(rows.n), held)
        out[held] = rows.logits(*rows.fit(y, rest, none), none)[held]
    slope, shift = platt(out, y)
    w, _, bias = rows.fit(y, np.arange(rows.n), none)
    return Model(rows.table(w, SPEC.bits), bias, slope, shift)


def repeated_in(words: list[bytes]) -> int:
    """Words within three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    repeated = until = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            repeated += i + 3 - max(i, until)
            until = i + 3
    return repeated


def repeated_in_long(text: str) -> tuple[int, int]:
    """The number of words, and repeated_in() of them: each distinct word has a number, so a word costs a few bytes."""
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(m[0], len(known)) for m in _WORD.finditer(text)), dtype=np.int32)
    n, size = len(ids), len(known)
    del known
    if n < 3:
        return n, 0
    # windows in order: by their last two words' numbers, exactly, then by their first's
    two = ids[1:-1].astype(np.int64) * size + ids[2:]
    order = np.lexsort((two, ids[:-2]))
    same = (two[order[1:]] == two[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]])
    often = np.zeros(n - 2, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : k + n - 2] |= often
    return n, int(covered.sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The rules' counts of one text and whether they fail it."""
    text = text or ""
    if len(text) > LONG:
        n, repeated = repeated_in_long(text)
    else:
        words = text.encode("utf-8", "surrogatepass").split()
        n, repeated = len(words), repeated_in(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)] if "\n" in text else []
    dup = len(lines) - len(set(lines))
    return n, chars, symbols, dup, repeated, n < 50 or 100 * repeated > 50 * n


def judge(documents: DataFrame, model: Model, threshold: float = KEEP) -> DataFrame:
    """doc_id, the rules' counts, base_failed, quality (probability) and kept, for every row."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = list(zip(*map(counts, texts))) or [[]] * 6
            p = held.value.probability(texts)
            failed = np.array(found[5], dtype=bool)
            columns = [pa.array(x, pa.int64()) for x in found[:5]] + [pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=NAMES)

    return documents.select("doc_id", "text").mapInArrow(make, f"doc_id long, {BASE}, quality double, kept boolean")


NAMES = ["doc_id", *(x.split()[0] for x in BASE.split(", ")), "quality", "kept"]


def keep(documents: DataFrame, model: Model, threshold: float = KEEP) -> DataFrame:
    """The rows that judge() keeps, with all their columns."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            p = held.value.probability(texts)
            good = [q >= threshold and not counts(t)[5] for t, q in zip(texts, p)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(make, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(documents, model)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
