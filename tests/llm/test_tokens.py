import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from wireloom.llm import bpe, packing, tokens

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "the", "é", "日本", "'s", "'ll", "1", "23", "!!", " ", " ", "\x1c", " ", "😀", "--", "Z", " \n ", "<|endoftext|>", "　"]


def texts(n):
    rnd = random.Random(n)
    made = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 60))) for _ in range(n)]
    return made + [None, "", " ", "\n", " a", "a ", "  a", "a" * 3000, "ab" * 1500, "日" * 800, " " * 900, "word " * 2000, "the quick brown fox " * 50]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_bpe_equals_the_library(monkeypatch, library, part):
    monkeypatch.setattr(tokens, "PART", part)
    e = bpe.Encoder(MULTI, public_tokenizers.PATTERN)
    all_texts = texts(1500)
    for t, ids in zip(all_texts, e.chunks.texts(all_texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t or "")
        assert e.decode(ids) == (t or "").encode()


def test_matrix_and_row_agree():
    e = bpe.Encoder(MULTI, public_tokenizers.PATTERN)
    rnd = random.Random(3)
    for _ in range(200):
        p = bytes(rnd.choices(b"abcdeth \xc3\xa9", k=rnd.randint(2, 120)))
        assert e.matrix([p], 1 << (len(p) - 1).bit_length()) == [e.row(p)]


def test_small_cache_gives_the_same(library):
    e = bpe.Encoder(MULTI, public_tokenizers.PATTERN)
    e.chunks = tokens.Chunks(e.encode, chunks=5)
    for t in texts(100):
        assert np.frombuffer(e.chunks.texts([t])[0], "<u4").tolist() == library.encode_ordinary(t or "")


def test_round_trip_query(spark, library):
    rows = list(enumerate(texts(100)))
    rows.append(rows[0])
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    found = bpe.round_trip(df, MULTI, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, found)) == sorted(want)
    assert bpe.round_trip(df.limit(0), MULTI, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_chunks_equal_the_tokenizers_library(monkeypatch, part):
    monkeypatch.setattr(tokens, "PART", part)
    t = Tokenizer.from_file(PLAIN)
    t.encode_special_tokens = True
    tokens.from_tokenizers.cache_clear()
    all_texts = texts(1500)
    for text, ids in zip(all_texts, tokens.from_tokenizers(PLAIN).texts(all_texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def plain_best_fit(lengths, window):
    left, sequence, offset = [], [None] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [k for k in range(len(left)) if left[k] >= lengths[i]]
        k = min(fits, key=lambda k: left[k]) if fits else len(left)
        if not fits:
            left.append(window)
        sequence[i], offset[i] = k, window - left[k]
        left[k] -= lengths[i]
    return sequence, offset, left


@pytest.mark.parametrize("window", [1, 7, 16, 1024])
def test_best_fit_fills_like_a_plain_search(window):
    rnd = random.Random(window)
    for n in (0, 1, 50, 400):
        lengths = [rnd.randint(1, window) for _ in range(n)]
        sequence, offset, last = packing.best_fit(lengths, window, 5)
        used = {}
        for s, o, x in sorted(zip(sequence, offset, lengths)):
            assert o == used.get(s, 0) and o + x <= window
            used[s] = o + x
        plain = plain_best_fit(lengths, window)[2]
        assert sorted(used.values()) == sorted(window - x for x in plain) and last == 5 + len(plain)


def check_pieces(rows, found, window):
    t = Tokenizer.from_file(PLAIN)
    t.encode_special_tokens = True
    want, have = [], []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, len(ids[k : k + window]), zlib.crc32(ids[k : k + window].tobytes()), len(ids)) for k in range(0, len(ids), window)]
    spans = {}
    for r in found:
        have.append((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens))
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(have) == sorted(want)
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return spans


@pytest.mark.parametrize("block", [1 << 24, 100])
def test_packing(spark, block):
    rows = list(enumerate(texts(150)))
    rows.append(rows[3])
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    check_pieces(rows, packing.pack(df, PLAIN, 64, block).collect(), 64)
    assert packing.pack(df.limit(0), PLAIN).collect() == []


def test_packed_ids_are_the_pieces(spark):
    df = spark.createDataFrame([(1, "hello big world " * 40)], "doc_id long, text string")
    for r in packing.pack(df, PLAIN, 32, ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_packing_leaves_little_padding(spark):
    found = packing.query(spark, "/root/testdata/sf0.01").collect()
    used = {}
    for r in found:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(1024 - n for n in used.values() if n & (n - 1)) < 0.01 * sum(used.values())


def test_long_pieces_equal_the_library(library):
    """Pieces of one character, of few, and of many, on both sides of the length from which a piece is a row of its own."""
    e = bpe.Encoder(MULTI, public_tokenizers.PATTERN)
    rnd = random.Random(9)
    made = [x * n for x in ("a", "ab", "日", "é", "-") for n in (255, 256, 511, 512, 513, 1025)]
    made += ["".join(rnd.choices(letters, k=n)) for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyzABCDEF", "дежзик日本語") for n in (500, 513, 2000, 40000)]
    for t, ids in zip(made, e.chunks.texts(made)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)


def test_a_merge_that_makes_a_lower_pair():
    """A made vocabulary whose pairs come in any order of rank, against single merges."""
    rnd = random.Random(11)
    for seed in range(60):
        words = {bytes([c]) for c in b"abc"}
        while len(words) < 40:
            words.add(rnd.choice(sorted(words)) + rnd.choice(sorted(words)))
        order = sorted(words, key=lambda w: (len(w) > 1, rnd.random()))
        e = bpe.Encoder.__new__(bpe.Encoder)
        e.ranks = {w: k for k, w in enumerate(order)}
        found = [(e.ranks[w[:k]] << 24 | e.ranks[w[k:]], r) for w, r in e.ranks.items() for k in range(1, len(w)) if w[:k] in e.ranks and w[k:] in e.ranks]
        e.pairs = bpe.Pairs(*np.array(found, dtype=np.int64).T)
        e.byte = np.array([e.ranks.get(bytes([k]), 0) for k in range(256)], dtype=np.int64)
        piece = bytes(rnd.choices(b"abc", k=rnd.randint(2, 300)))
        plain = [bytes([c]) for c in piece]
        while True:
            ranks = [(e.ranks[a + b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a + b in e.ranks]
            if not ranks:
                break
            _, i = min(ranks)
            plain[i : i + 2] = [plain[i] + plain[i + 1]]
        assert np.frombuffer(e.row(piece), "<u4").tolist() == [e.ranks[w] for w in plain]
        assert e.matrix([piece], 1 << (len(piece) - 1).bit_length()) == [e.row(piece)]
