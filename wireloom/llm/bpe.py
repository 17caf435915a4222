"""Byte-level BPE encoding and decoding by ranks.

Distinct pieces of text that aren't yet known become rows of padded matrices, one for each
power-of-two length.  In each round every row merges its leftmost pair of least rank;
ranks of pairs come from an open-addressing hash table in arrays, merged places are closed up, and rows
without a further pair leave.  A whole piece that is in the vocabulary is its own token.  A piece of
over LONG bytes is a matrix of one row: a round merges all places of its least rank, from the left, unless a
merge makes a pair of lower rank (then the leftmost only), and places are closed up once half of them are merged; the
order of merges, and so the result, is that of single merges.  Known chunks are kept in a bounded dictionary per worker (tokens.Chunks).

Defined results: a null or empty text has no ids; repeated rows give repeated results; an empty table gives no rows;
texts of any length are encoded whole; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from wireloom.llm.tokens import Chunks

LONG = 512
NONE = np.int64(1 << 40)
_SCATTER = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """Ranks of pairs of ids in a linear-probing hash table."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int64)
        self.probes = 0
        left = np.arange(len(keys))
        while len(left):
            at = self.slot(keys[left], self.probes)
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[at[put]], self.ranks[at[put]] = keys[left[put]], ranks[left[put]]
            left = np.delete(left, put)
            self.probes += 1

    def slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys.astype(np.uint64) * _SCATTER) >> self.shift).astype(np.int64) + probe) & self.mask

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE for those that don't merge, or where an id is negative."""
        keys = (a.astype(np.int64) << 24) | b
        keys[(a < 0) | (b < 0)] = -2
        flat = keys.ravel()
        at = self.slot(flat, 0)
        found = self.keys[at]
        out = np.where(found == flat, self.ranks[at], NONE)
        left = np.flatnonzero((found != flat) & (found >= 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            at = self.slot(flat[left], probe)
            found = self.keys[at]
            hit = found == flat[left]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit & (found >= 0)]
        return out.reshape(keys.shape)


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for b, r in self.ranks.items():
            self.token[r] = b
        found = [(self.ranks[b[:k]] << 24 | self.ranks[b[k:]], r) for b, r in self.ranks.items() for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks]
        self.pairs = Pairs(*np.array(found, dtype=np.int64).T)
        self.byte = np.array([self.ranks[bytes([k])] for k in range(256)], dtype=np.int64)
        self.chunks = Chunks(self.encode)

    def encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as bytes; each match of the pattern merges by itself."""
        split = [[p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(c)] for c in chunks]
        known = self.merged({p for pieces in split for p in pieces})
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def merged(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        out, sized = {}, {}
        for p in pieces:
            rank = self.ranks.get(p)
            if rank is not None:
                out[p] = rank.to_bytes(4, "little")
            elif len(p) > LONG:
                out[p] = self.row(p)
            else:
                sized.setdefault((len(p) - 1).bit_length(), []).append(p)
        for bits, rows in sized.items():
            step = max(1, (1 << 20) >> bits)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                out.update(zip(part, self.matrix(part, 1 << bits)))
        return out

    def matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        filled = np.arange(width) < n[:, None]
        ids = np.full((len(pieces), width), -1, dtype=np.int64)
        ids[filled] = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = np.full(ids.shape, NONE, dtype=np.int64)
        rank[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        done: list[bytes] = [b""] * len(pieces)
        row = np.arange(len(pieces))
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            over = best == NONE
            if over.any():
                for r, x in zip(row[over], ids[over]):
                    done[r] = x[x >= 0].astype("<u4").tobytes()
                go = ~over
                row, ids, rank, at, best = row[go], ids[go], rank[go], at[go], best[go]
                if not len(row):
                    return done
                wide = int((ids >= 0).sum(axis=1).max())
                ids, rank = ids[:, :wide], rank[:, :wide]
            every = np.arange(len(row))
            ids[every, at] = best
            # close the gap after the merged place; the last column becomes empty
            column = np.arange(ids.shape[1] - 1)
            take = column + (column > at[:, None])
            ids[:, :-1], rank[:, :-1] = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            ids[:, -1], rank[:, -1] = -1, NONE
            right = np.minimum(at + 1, ids.shape[1] - 1)
            rank[every, at] = np.where(right > at, self.pairs(ids[every, at], ids[every, right]), NONE)
            some = at > 0
            rank[every[some], at[some] - 1] = self.pairs(ids[every[some], at[some] - 1], ids[every[some], at[some]])

    def row(self, piece: bytes) -> bytes:
        """The same merges in a row of any length; merged places are passed over by links until they are closed up."""
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)]
        while True:
            n = len(ids)
            # what stands after and before each place; n for none, and there an id that merges with nothing
            after, before = np.arange(1, n + 2), np.arange(-1, n)
            ids = np.append(ids, -1)
            rank = np.append(self.pairs(ids[:-1], ids[1:]), NONE)
            live = n
            while live > n // 2 or live < 64:
                least = rank.min()
                if least == NONE:
                    return ids[ids >= 0].astype("<u4").tobytes()
                at = np.flatnonzero(rank == least)
                if len(at) > 1:
                    # of overlapping places every second, from the left
                    chained = np.append(False, after[at[:-1]] == at[1:])
                    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
                gone = after[at]
                left, right = before[at], after[gone]
                # as each merge finds it: those to its left are done, those to its right are not
                merged = np.append(False, right[:-1] == at[1:])
                new = np.full(len(at), least)
                low = np.minimum(self.pairs(np.where(merged, least, ids[left]), new), self.pairs(new, ids[right]))
                if len(at) > 1 and (low < least).any():
                    at, gone = at[:1], gone[:1]
                ids[at], ids[gone], rank[gone] = least, -1, NONE
                after[at] = after[gone]
                before[after[at]] = at
                live -= len(at)
                some = np.concatenate((at, before[at[before[at] >= 0]]))
                rank[some] = self.pairs(ids[some], ids[after[some]])
            ids = ids[ids >= 0]

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").tolist()
        if len(at) < 2:
            return b"".join([self.token[k] for k in at])
        return b"".join(itemgetter(*at)(self.token))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for every row; ids as little-endian unsigned 32-bit numbers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder(path, pattern).chunks.texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(make, "doc_id long, ids binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row; ids are decoded where they were made."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = encoder(path, pattern)
            ids = e.chunks.texts(batch.column(1).to_pylist())
            columns = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN)
