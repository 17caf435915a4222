"""Hashed word and character n-grams of many texts at once, and logistic models over them.

Texts are laid end to end as code points.  One running polynomial hash then gives the hash of
any substring by two lookups, so words, word pairs and character n-grams cost a few array
operations per code point and no Python loop over tokens.

Long texts are taken in pieces.  A piece ends between two words, and the next one is led by the words and characters that
n-grams reaching into it begin with; an n-gram counts in the piece where it ends.  So the pieces' n-grams are the
text's, wherever it is cut.  A word of over WORD code points counts as words of that length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Code points handled at once; a longer text is taken in pieces. At least WORD.
PIECE = 1 << 17
#: Code points after which a word ends.
WORD = 1 << 16
#: Values of training rows that a step of a fit takes at once.
PART = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(128, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BREAK = np.array([not chr(i).isalnum() for i in range(128)])
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for x in (_BASE, back):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers


@dataclass(frozen=True)
class Grams:
    """Which n-grams count, and in how many buckets they fall."""

    words: tuple[int, ...] = (1, 2)
    chars: tuple[int, ...] = (3,)
    bits: int = 18
    #: Lengths of the beginnings of words that count too, of words as long or longer.
    starts: tuple[int, ...] = ()
    #: Whether ASCII punctuation ends a word, as white space does.
    letters: bool = False
    #: Whether a bucket's value is 1 wherever it occurs, rather than its count over the root of all counts.
    presence: bool = False

    @property
    def families(self) -> int:
        return len(self.words) + len(self.starts) + len(self.chars)


def bucket(h: np.ndarray, family: int, bits: int) -> np.ndarray:
    h = h + np.uint64(family * 0x632BE59BD9B4E019 % (1 << 64))
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h ^= h >> np.uint64(29)
    h *= _BASE
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def groups(texts: list[str | None], spec: Grams) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Pieces of texts, about PIECE code points at a time: the row of each, each with what leads it, and the length of that."""
    rows: list[int] = []
    parts: list[str] = []
    leads: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for part, lead in [(t, 0)] if len(t) <= PIECE else pieces(t, spec):
            if held and held + len(part) > PIECE:
                yield rows, parts, leads
                rows, parts, leads, held = [], [], [], 0
            rows.append(i)
            parts.append(part)
            leads.append(lead)
            held += len(part) + 1
    if rows:
        yield rows, parts, leads


def pieces(text: str, spec: Grams) -> Iterator[tuple[str, int]]:
    """A long text's pieces, each with the length of what leads it."""
    breaks = "".join(chr(k) for k in np.flatnonzero(_BREAK if spec.letters else _SPACE))
    last = re.compile(f"[{re.escape(breaks)}][^{re.escape(breaks)}]*\\Z")
    word = re.compile(f"[^{re.escape(breaks)}]{{1,{WORD}}}")
    # the characters, and words, before a piece that its n-grams may begin with
    chars = max(spec.chars, default=1) - 1
    words = max(max(spec.words, default=1) - 1, int(chars > 0))
    before: list[tuple[int, int]] = []
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            first = word.search(text, at, at + PIECE)
            cut = last.search(text, first.start() + 1, at + PIECE) if first else None
            # between words, or after whole lengths of a long one, or within white space
            end = cut.start() if cut else at + PIECE
            if first and not cut:
                whole = (end - first.start()) // WORD
                end = first.start() + whole * WORD if whole else word.match(text, first.start()).end()
        lead = ""
        if before or chars and at:
            word_at = before[0][0] if before else at
            since = min(word_at, max(at - chars, 0))
            if since < word_at and text[word_at - 1] not in breaks:
                since = word_at - WORD
            lead = text[since:word_at]
            for (a, b), after in zip(before, [*(a for a, _ in before[1:]), at]):
                lead += text[a:b] + text[max(b, after - chars - 1) : after]  # of much white space its end
        yield lead + text[at:end], len(lead)
        if words:
            before = [*before, *((m.start(), m.end()) for m in word.finditer(text, at, end))][-words:]
        at = end


def spans(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ascending, disjoint spans."""
    steps = np.zeros(n + 1, dtype=np.int64)
    some = high > low
    np.add.at(steps, low[some], 1)
    np.add.at(steps, high[some], -1)
    return np.cumsum(steps[:-1]) > 0


def grams(parts: list[str], spec: Grams, leads: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per family of n-grams: the buckets in text order, and where each part's buckets start (one more than parts).

    N-grams that end in the first so many (leads) code points of a part don't count.
    """
    raw = "\n".join(parts) + "\n"
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    own = starts + np.array(leads or [0] * len(parts), dtype=np.int64)
    ahead, back = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * ahead[: len(codes)], out=total[1:])
    space = (codes < 128) & (_BREAK if spec.letters else _SPACE)[np.minimum(codes, 127).astype(np.int64)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    if len(begin) and (end - begin).max() > WORD:
        n = -(-(end - begin) // WORD)
        begin, end = np.repeat(begin, n), np.repeat(end, n)
        begin = begin + WORD * (np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(end, begin + WORD)
    word = (total[end] - total[begin]) * back[begin]
    first = np.searchsorted(begin, starts)
    mine = np.searchsorted(begin, own)
    last = np.searchsorted(begin, ends)
    family = 0
    for n in spec.words:
        h = word
        for k in range(1, n):
            h = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[k:] if len(h) else h
        low = np.maximum(first, mine - n + 1)
        high = np.maximum(last - n + 1, low)
        yield bucket(h[spans(low, high, len(h))], family, spec.bits), np.concatenate(([0], np.cumsum(high - low)))
        family += 1
    for n in spec.starts:
        long = end - begin >= n
        long &= spans(mine, last, len(long))
        so_far = np.concatenate(([0], np.cumsum(long)))
        h = (total[begin[long] + n] - total[begin[long]]) * back[begin[long]]
        yield bucket(h, family, spec.bits), np.concatenate(([0], np.cumsum(so_far[last] - so_far[mine])))
        family += 1
    for n in spec.chars:
        h = (total[n:] - total[:-n]) * back[: len(codes) + 1 - n] if len(codes) >= n else total[:0]
        low = np.maximum(starts, own - n + 1)
        high = np.maximum(ends - n + 1, low)
        yield bucket(h[spans(low, high, len(h))], family, spec.bits), np.concatenate(([0], np.cumsum(high - low)))
        family += 1


def score(texts: list[str | None], spec: Grams, tables: list[np.ndarray]) -> np.ndarray:
    """Per text and table: the sum over families of a family's summed weights over the root of its n-gram count."""
    sums = np.zeros((len(tables), spec.families, len(texts)))
    counts = np.zeros((spec.families, len(texts)))
    for rows, parts, leads in groups(texts, spec):
        at = np.asarray(rows)
        for f, (b, bounds) in enumerate(grams(parts, spec, leads)):
            np.add.at(counts[f], at, np.diff(bounds))
            for t, table in enumerate(tables):
                run = np.zeros(len(b) + 1)
                np.cumsum(table[b], out=run[1:])
                np.add.at(sums[t, f], at, run[bounds[1:]] - run[bounds[:-1]])
    return (sums / np.sqrt(np.maximum(counts, 1))).sum(axis=1).T


def present(texts: list[str | None], spec: Grams, buckets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per text and column of weights: the sum over the given buckets (ascending, few) that the text holds."""
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[buckets & 0xFFFF] = True
    pairs = [np.zeros(0, dtype=np.int64)]
    for rows, parts, leads in groups(texts, spec):
        for b, bounds in grams(parts, spec, leads):
            near = np.flatnonzero(maybe[b & 0xFFFF])
            place = np.minimum(np.searchsorted(buckets, b[near]), max(len(buckets) - 1, 0))
            hit = buckets[place] == b[near] if len(near) else np.zeros(0, bool)
            row = np.asarray(rows)[np.searchsorted(bounds, near[hit], "right") - 1]
            pairs.append(np.unique(row * len(buckets) + place[hit]))
    found = np.unique(np.concatenate(pairs))
    out = np.zeros((len(texts), weights.shape[1]))
    np.add.at(out, found // max(len(buckets), 1), weights[found % max(len(buckets), 1)])
    return out


def sparse(text: str | None, spec: Grams) -> tuple[np.ndarray, np.ndarray]:
    """One text's buckets, ascending, and their values, as score() weighs them."""
    found: list[list[np.ndarray]] = [[] for _ in range(spec.families)]
    for _, parts, leads in groups([text], spec):
        for f, (b, _) in enumerate(grams(parts, spec, leads)):
            found[f].append(b)
    ids, values = [], []
    for x in found:
        b, n = np.unique(np.concatenate(x), return_counts=True)
        ids.append(b)
        values.append(np.ones(len(n)) if spec.presence else n / np.sqrt(max(n.sum(), 1)))
    at, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    return at, np.bincount(inverse, weights=np.concatenate(values), minlength=len(at)).astype(np.float32)


class Rows:
    """Sparse training rows over the buckets that at least `least` rows hold; further dense columns may follow."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray], least: int = 4):
        """ids: each row's buckets, ascending. Lists are emptied as they are taken over."""
        ids, values = (x if isinstance(x, list) else list(x) for x in (ids, values))
        self.buckets = self.held(ids, least)
        self.n, self.width = len(ids), len(self.buckets)
        row, col, val = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for k, (x, v) in enumerate(zip(ids, values)):
            found = np.searchsorted(self.buckets, x)
            ok = self.buckets[np.minimum(found, self.width - 1)] == x if self.width else np.zeros(len(x), bool)
            row.append(np.full(int(ok.sum()), k, np.int32))
            col.append(found[ok].astype(np.int32))
            val.append(v[ok].astype(np.float32))
            ids[k] = values[k] = None
        self.row, self.col, self.val = map(np.concatenate, (row, col, val))

    @staticmethod
    def held(ids: list[np.ndarray], least: int) -> np.ndarray:
        """The buckets that so many rows hold; few buckets are counted in place."""
        most = max((int(x[-1]) for x in ids if len(x)), default=0)
        if most < 1 << 22:
            count = np.zeros(most + 1, dtype=np.int32)
            for x in ids:
                count[x] += 1
            return np.flatnonzero(count >= least)
        at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *ids]), return_counts=True)
        return at[n >= least]

    def fit(self, y: np.ndarray, rows: np.ndarray, dense: np.ndarray, l2: float = 2e-3, steps: int = 80, least_z: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
        """Logistic regression on some rows by full-batch Adam: weights of buckets, of dense columns, and the bias.

        least_z: only buckets whose share of rows differs between the classes by so many standard errors take part.
        """
        pick = np.zeros(self.n, dtype=bool)
        pick[rows] = True
        use = pick[self.row]
        if least_z:
            use &= (abs(self.differs(y, pick)) >= least_z)[self.col]
        r, c, v = self.row[use], self.col[use], self.val[use]
        target, m = y[pick].astype(float), int(pick.sum())
        at = np.cumsum(pick) - 1
        r, d = at[r], dense[pick]
        edges = np.searchsorted(r, np.arange(m + 1))
        # rows in parts of about PART values, so that a step needs little memory
        cuts = np.unique(np.append(np.searchsorted(edges, np.arange(0, len(r), PART)), m)) if m else np.zeros(1, int)
        size = self.width + d.shape[1] + 1
        w, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
        rate = float(np.clip(target.mean() if m else 0.5, 1e-3, 1 - 1e-3))
        w[-1] = np.log(rate / (1 - rate))
        for t in range(1, steps + 1):
            z, slope = d @ w[self.width : -1] + w[-1], np.zeros(self.width)
            for low, high in zip(cuts, cuts[1:]):
                run = np.concatenate(([0.0], np.cumsum(w[c[edges[low] : edges[high]]] * v[edges[low] : edges[high]])))
                at_ = edges[low : high + 1] - edges[low]
                z[low:high] += run[at_[1:]] - run[at_[:-1]]
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / max(m, 1)
            for low, high in zip(cuts, cuts[1:]):
                part = slice(edges[low], edges[high])
                slope += np.bincount(c[part], weights=g[r[part]] * v[part], minlength=self.width)
            grad = np.concatenate((slope, d.T @ g, [g.sum()]))
            grad[:-1] += l2 * w[:-1] / max(self.width, 1)
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.99 * m2 + 0.01 * grad * grad
            w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
        return w[: self.width], w[self.width : -1], float(w[-1])

    def differs(self, y: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """Standard errors by which the classes' shares of rows that hold a bucket differ, over the picked rows."""
        use = pick[self.row]
        one = np.bincount(self.col[use], weights=y[self.row[use]], minlength=self.width)
        both = np.bincount(self.col[use], minlength=self.width)
        n, n1 = max(int(pick.sum()), 1), max(int(y[pick].sum()), 1)
        n0, share = max(n - n1, 1), both / n
        return (one / n1 - (both - one) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))

    def logits(self, w: np.ndarray, u: np.ndarray, b: float, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col] * self.val, minlength=self.n) + dense @ u + b

    def table(self, w: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, dtype=np.float64)
        out[self.buckets] = w
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities, by Newton steps on smoothed targets; (1, 0) for one class."""
    p, n = float((y == 1).sum()), float((y == 0).sum())
    if not p or not n:
        return 1.0, 0.0
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    def loss(x: np.ndarray) -> float:
        q = x[0] * z + x[1]
        return float((np.logaddexp(0, q) - t * q).sum() + 5e-4 * (x[0] - 1) ** 2)

    z = np.clip(z, -1e3, 1e3)
    x = np.array([1.0, 0.0])
    for _ in range(steps):
        q = sigmoid(x[0] * z + x[1])
        g, h = q - t, np.maximum(q * (1 - q), 1e-9)
        gradient = np.array([(g * z).sum() + 1e-3 * (x[0] - 1), g.sum()])
        curve = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(curve, gradient)
        while loss(x - step) > loss(x) and abs(step).max() > 1e-9:
            step = step / 2
        x = x - step
        if abs(step).max() < 1e-7:
            break
    # a falling slope only comes of scores that say nothing
    return (float(x[0]), float(x[1])) if x[0] > 0 else (1.0, 0.0)


def folds(y: np.ndarray, k: int = 4) -> list[np.ndarray]:
    """Row numbers in k folds; each class's rows are dealt in turn."""
    dealt = [np.concatenate([np.flatnonzero(y == c)[i::k] for c in np.unique(y)]) for i in range(k)] if len(y) else []
    return [np.sort(f) for f in dealt if len(f)]
