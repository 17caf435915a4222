"""Whole texts to token ids by cached chunks.

A pattern that splits text before merges (word with one leading space, number, punctuation run,
white space run) always starts a new piece at a single space between two characters that
aren't white space.  So text cut there can be encoded chunk by chunk, and chunks repeat:
a bounded dictionary per Python worker holds their ids as bytes.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np

#: Characters that are split into chunks at once.
PART = 1 << 20
#: Chunks that are encoded in one string.
RUN = 512
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Chunks:
    """Encodes texts by a function that encodes many chunks; each result is the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], chunks: int = 800_000, characters: int = 64_000_000):
        self.encode, self.most, self.most_characters = encode, chunks, characters
        self.first: dict[str, bytes | bool] = {}
        self.later: dict[str, bytes | bool] = {}
        self.size = 0

    def learn(self, known: dict[str, bytes | bool], parts: set[str], lead: str, strict: bool) -> None:
        new = list(parts)
        if not new:
            return
        good = new
        if strict:  # False: the cut beside this part may not be one
            good = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
            if len(good) < len(new):
                known.update(dict.fromkeys(parts.difference(good), False))
        known.update(zip(good, self.encode([lead + p for p in good])))
        self.size += sum(map(len, new))

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for null. About PART characters are split at a time."""
        collects = gc.isenabled()
        gc.disable()  # millions of strings in lists, none of them in cycles
        try:
            return self.encoded(texts)
        finally:
            if collects:
                gc.enable()

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        rows: list[int] = []
        parts: list[tuple[str, bool]] = []
        held = 0
        for i, t in enumerate(texts):
            for part in pieces(t or ""):
                if held + len(part[0]) > PART and parts:
                    self.put(out, rows, parts)
                    rows, parts, held = [], [], 0
                rows.append(i)
                parts.append(part)
                held += len(part[0])
        self.put(out, rows, parts)
        return [b"".join(x) for x in out]

    def put(self, out: list[list[bytes]], rows: list[int], parts: list[tuple[str, bool]]) -> None:
        if len(self.first) + len(self.later) > self.most or self.size > self.most_characters:
            # what was learned first is what occurs most
            self.first, self.later = {}, dict(islice(self.later.items(), len(self.later) // 2))
            self.size = sum(map(len, self.later))
            if self.size > self.most_characters:
                self.later, self.size = {}, 0
        get = self.later.get
        waiting = []
        for text, later in parts:
            split = text.split(" ")
            found = list(map(get, split))
            if not later:
                found[0] = self.first.get(split[0])
            waiting.append((split, found, missing(found)))
        self.learn(self.first, {s[0] for (s, _, new), (_, later) in zip(waiting, parts) if new and not new[0] and not later}, "", True)
        self.learn(self.later, {s[k] for (s, _, new), (_, later) in zip(waiting, parts) for k in new if k or later}, " ", True)
        for i, (split, found, new), (text, later) in zip(rows, waiting, parts):
            for k in new:
                found[k] = self.later[split[k]] if k or later else self.first[split[k]]
            out[i].append(self.whole(text, later) if False in found else b"".join(found))

    def whole(self, text: str, later: bool) -> bytes:
        """For texts with white space beside spaces; later: whether a space goes before."""
        if not text and not later:
            return b""
        parts = _CUT.split(text)
        first: dict[str, bytes | bool] = {}
        self.learn(first, {parts[0]}, " " if later else "", False)
        rest: dict[str, bytes | bool] = {}
        self.learn(rest, {p for p in parts[1:] if not self.later.get(p)}, " ", False)
        return b"".join([first[parts[0]], *(rest.get(p) or self.later[p] for p in parts[1:])])


def missing(found: list) -> list[int]:
    """Where a list holds None."""
    out, k = [], -1
    try:
        while True:
            out.append(k := found.index(None, k + 1))
    except ValueError:
        return out


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """A long text in pieces that are encoded by themselves, each with whether the space before it was cut off."""
    at, later = 0, False
    while len(text) - at > PART:
        cut = _CUT.search(text, at + PART)
        if not cut:
            break
        yield text[at : cut.start()], later
        at, later = cut.end(), True
    yield text[at:] if at else text, later


def sliced(ids: np.ndarray, sizes: np.ndarray, chunks: list[str]) -> list[bytes]:
    """The ids of chunks that were encoded in one string, told apart by the tokens' sizes in bytes."""
    ends = np.cumsum(sizes[ids])
    joined = np.frombuffer("".join(chunks).encode("utf-8", "surrogatepass"), np.uint8)
    spaces = np.flatnonzero(joined == 32)
    if len(spaces) == len(chunks):  # each chunk has the one that it begins with
        lengths = np.append(spaces[1:], len(joined))
    else:
        lengths = np.cumsum(np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in chunks), dtype=np.int64, count=len(chunks)))
    at = (4 * np.searchsorted(ends, lengths, "right")).tolist()
    raw = ids.astype("<u4").tobytes()
    return [raw[a:b] for a, b in zip([0, *at], at)]


@lru_cache(maxsize=2)
def from_tokenizers(path: str) -> Chunks:
    """Chunks encoded by the tokenizers library's file at path, a byte-level one; special tokens' strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    sizes = np.zeros(t.get_vocab_size(), dtype=np.int64)
    for token, k in t.get_vocab(with_added_tokens=False).items():
        sizes[k] = len(token)  # a character stands for a byte

    def encode(parts: list[str]) -> list[bytes]:
        if any(not p.startswith(" ") for p in parts):
            return [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch_fast(parts, add_special_tokens=False)]
        runs = [parts[k : k + RUN] for k in range(0, len(parts), RUN)]
        found = t.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False)
        return [c for r, x in zip(runs, found) for c in sliced(np.array(x.ids, np.int64), sizes, r)]

    return Chunks(encode)
