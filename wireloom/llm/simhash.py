"""SimHash near-duplicates by segment popcounts.

A document's fingerprint is the bitwise majority of its shingles' XXH64 values.  Distinct
fingerprints are embedded as the popcounts of 32 two-bit segments.  The Manhattan distance of two
embeddings is at most the Hamming distance of the fingerprints, so fingerprints within k bits
are within k in the embedding.  The embedding is kept in unary code (0, 1, 3 for popcounts 0, 1, 2),
whose Hamming distance is the Manhattan distance of the counts: one 64-bit number, compared by
xor and bit_count in generated code.

The range join: the 32 counts form six groups.  Of two embeddings within distance 2 at least four
groups are equal, so each fingerprint goes to the 15 grid cells that fix four groups; a cell's
fingerprints are compared, first in Manhattan distance, then exactly.  Cells of more than CELL
distinct fingerprints aren't compared pairwise, as their pairs grow with the square: there the range join goes over the
finest grid, whose segments are single bits, so that its Manhattan distance is the Hamming distance itself.  Both sides
of a pair within 2 reach one cell within 1 of each, so a fingerprint goes to its own cell and the 64 next to it, and the
fingerprints of a cell (65 at most) are linked through its least; all lie within 2 of one another.  Rows stay in proportion, and
the links connect the same fingerprints.

Only cells of two or more fingerprints are joined, salted, so a cell may hold any share of
the rows.  Exact copies meet in one fingerprint before any join.

Defined results: a null, empty or blank text has fingerprint 0, linked as any other.  Repeated ids
each get a row; a null id gets a row too, and its component's smallest id is taken over
ids that aren't null (null if there is none).  An empty table gives no rows; texts of any length are read whole; of
other columns only stage() takes notice, which keeps them, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wireloom.llm.components import components
from wireloom.llm.shared import kept

SEED = 42
#: Distinct fingerprints in a cell that are still compared pairwise.
CELL = 32
SALTS = 16
_LOW = 0x5555555555555555
_GROUPS = [(0, 10), (10, 10), (20, 10), (30, 10), (40, 12), (52, 12)]
_CHUNK = 1 << 16
#: Bytes from which a text's words are taken one by one.
LONG = 1 << 22
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, size: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    h = xxhash.xxh64_intdigest
    if len(data) > LONG:
        shingles = sliding(data, size)
    else:
        words = data.split()
        few = [tuple(words)] if words and len(words) < size else []
        shingles = iter(few) if len(words) < size else zip(*(words[k:] for k in range(size)))
    values = (h(b" ".join(w), SEED) for w in shingles)
    count, n = np.zeros(64, dtype=np.int64), 0
    while len(part := np.fromiter(islice(values, _CHUNK), dtype="<u8")):
        n += len(part)
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def sliding(data: bytes, size: int) -> Iterator[tuple[bytes, ...]]:
    """The shingles of a long text, without a list of its words; the whole sequence if it has fewer words."""
    held: deque[bytes] = deque(maxlen=size)
    n = 0
    for m in _WORD.finditer(data):
        held.append(m[0])
        n += 1
        if n >= size:
            yield tuple(held)
    if 0 < n < size:
        yield tuple(held)


def fingerprints(documents: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(make, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Popcounts of the two-bit segments, each in unary code."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def masks() -> list[int]:
    """For each choice of two groups: the bits of the other four."""
    bits = [((1 << n) - 1) << at for at, n in _GROUPS]
    return [signed(sum(bits) - bits[i] - bits[j]) for i, j in combinations(range(6), 2)]


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect just what differs in at most 2 bits."""
    e = fps.select("fp", embedding(F.col("fp")).alias("e"))
    cells = e.select("fp", "e", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in masks()])).alias("pos", "key"))
    shared = cells.groupBy("pos", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    met = kept(cells.withColumn("salt", salt).join(shared, ["pos", "key", "salt"]).drop("salt"))
    few = met.where(F.col("n") <= cell)
    a, b = (few.select("pos", "key", F.col("fp").alias(x), F.col("e").alias(f"e{x}")) for x in "ab")
    pairs = a.join(b, ["pos", "key"]).where("a < b and bit_count(ea ^ eb) <= 2 and bit_count(a ^ b) <= 2").select("a", "b").distinct()
    many = met.where(F.col("n") > cell).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << k))) for k in range(64)])
    # a cell of the finest grid has at most 65 distinct fingerprints within 1
    balls = many.select("fp", F.explode(near).alias("point")).groupBy("point").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all"))
    stars = balls.where("size(all) > 1").select(F.explode("all").alias("a"), "b").where("a != b")
    return pairs.union(stars)


def grouped(documents: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    docs = kept(fingerprints(documents, size))
    fps = kept(docs.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    roots = kept(components(links(fps)))
    first = kept(roots.join(fps, roots.node == fps.fp).groupBy("root").agg(F.min("doc").alias("first")))
    of = roots.join(first, "root").select(F.col("node").alias("fp"), "first")
    of = kept(fps.join(of, "fp", "left").select("fp", F.coalesce("first", "doc").alias("component_id")))
    return docs.join(of, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def marked(docs: DataFrame, name: str, size: int = 3) -> DataFrame:
    """The rows with their fingerprints in a further column."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield batch.append_column(name, pa.array(fp))

    return docs.mapInArrow(make, StructType([*docs.schema.fields, StructField(name, LongType())]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that with the smallest id, rows without an id last.

    Which row stays is decided on fingerprints and ids; rows move once, to meet that.  Rows that share the id and the
    fingerprint are one document.
    """
    fp, doc, none = free(docs, "fp"), free(docs, "doc"), free(docs, "none")
    rows = marked(docs, fp)
    fps = kept(rows.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("doc")))
    of = fps.join(kept(components(links(fps))), F.col("fp") == F.col("node"), "left")
    best = of.groupBy(F.coalesce("root", "fp")).agg(F.min(F.struct(F.col("doc").isNull(), "doc", "fp")).alias("best"))
    # keys without nulls, so that the rows stay where the join has put them when repeats go
    key = lambda c: (F.coalesce(c, F.lit(0)).cast("long").alias(doc), c.isNull().alias(none))
    best = best.select(F.col("best.fp").alias(fp), *key(F.col("best.doc")))
    found = rows.select("*", *key(F.col("doc_id"))).join(best, [fp, doc, none], "left_semi")
    return found.dropDuplicates([fp, doc, none]).select(*[F.col(f"`{c}`") for c in docs.columns])


def free(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
