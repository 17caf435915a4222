"""Packing by best-fit decreasing.

A document is its token ids and an end id.  Documents over a window are first cut into
full windows, which are sequences of their own.  The rest of each document goes, longest first, to the
open window with the least room that holds it; a segment tree over remaining capacities finds it.
Each task packs blocks of at most BLOCK tokens and ROWS pieces of what its partition holds, so memory is
bounded and no row is shuffled; a block leaves only its last few windows unfilled.

Strings of special tokens in a text are ordinary text, as in the vocabulary files' own description
(encode_special_tokens = True); so no text can forge a document's end.

Defined results: a null or empty text is the end id alone; repeated rows are packed each;
an empty table gives no pieces; texts of any length are encoded whole; other columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from wireloom.llm.tokens import from_tokenizers

WINDOW = 1024
#: Tokens, and pieces, that a task holds at once.
BLOCK, ROWS = 1 << 24, 1 << 18
END = b"\0\0\0\0"
SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Room:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest that is large enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, left: int, sequence: int) -> None:
        self.open[left].append(sequence)
        at = left + self.leaves
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A window of the least capacity from `need` on, now removed, with that capacity."""
        tree, at = self.tree, need + self.leaves
        if not tree[at]:
            while at & 1 or not tree[at + 1]:
                at >>= 1
                if not at:
                    return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not tree[at]:
                    at += 1
        left = at - self.leaves
        while at:
            tree[at] -= 1
            at >>= 1
        return left, self.open[left].pop()


def best_fit(lengths: list[int], window: int, first: int) -> tuple[list[int], list[int], int]:
    """Per item its sequence and offset, and the next free sequence number; longest items first, ties in order."""
    room, sequence, offset = Room(window), [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[i])
        if found is None:
            found = window, first
            first += 1
        left, sequence[i] = found
        offset[i] = window - left
        if left > lengths[i]:
            room.add(left - lengths[i], sequence[i])
    return sequence, offset, first


def pack(documents: DataFrame, path: str, window: int = WINDOW, block: int = BLOCK, ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `ids` the ids themselves."""
    schema = SCHEMA.append(pa.field("ids", pa.binary())) if ids else SCHEMA

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            done = []
            for i, found in zip(batch.column(0).cast(pa.int64()).to_pylist(), from_tokenizers(path).texts(batch.column(1).to_pylist())):
                found += END
                n = len(found) // 4
                for start in range(0, n, window):
                    part = found[4 * start : 4 * (start + window)]
                    row = (i, start, len(part) // 4, zlib.crc32(part), n, part if ids else None)
                    if row[2] == window:
                        done.append((*row[:5], following, 0, row[5]))
                        following += 1
                    else:
                        held.append(row)
                        tokens += row[2]
            if done:
                yield table(done)
            if tokens > block or len(held) > ROWS:
                following, out = settle(held, following)
                yield table(out)
                held, tokens = [], 0
        if held:
            yield table(settle(held, following)[1])

    def settle(held: list[tuple], following: int) -> tuple[int, list[tuple]]:
        sequence, offset, following = best_fit([r[2] for r in held], window, following)
        return following, [(*r[:5], s, o, r[5]) for r, s, o in zip(held, sequence, offset)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(make, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
