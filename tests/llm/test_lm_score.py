import math
import random
from collections import Counter

import numpy as np
import pytest

from wireloom.llm import lm_score


def plain(rows, targets, most, backing, size):
    """The same models by dictionaries, with bigrams counted exactly; each document leaves itself out."""
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    count = Counter(w for _, ws in texts for w in ws)
    known = {w: k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], w.encode()))[:most], 1)}
    n = len(known) + 2
    ids = [(i, [known.get(w, 0) for w in ws]) for i, ws in texts]
    out = []
    for k, (i, own) in enumerate(ids):
        losses = []
        for pick in (lambda j: j in targets, lambda j: True):
            rest = [ws for m, (j, ws) in enumerate(ids) if m != k and pick(j)]
            pairs = Counter(p for ws in rest for p in zip([n - 1, *ws], ws))
            contexts, words = Counter(), Counter(w for ws in rest for w in ws)
            for (a, _), c in pairs.items():
                contexts[a] += c
            total = sum(words.values())
            losses.append([-math.log2((pairs[a, b] + backing * (words[b] + 1) / (total + n)) / (contexts[a] + backing)) for a, b in zip([n - 1, *own], own)])
        m = len(own)
        out.append((i, m, *((sum(x) / m if m else None) for x in (*losses, [a - b for a, b in zip(*losses)]))))
    return out


@pytest.mark.parametrize("most", [3, 1000])
def test_matches_plain_models(spark, most):
    rnd = random.Random(most)
    rows = [(k, " ".join(rnd.choices("a b c d e f g h".split(), k=rnd.randint(0, 40)))) for k in range(40)]
    rows += [(50, None), (51, " \n"), (None, "a b a b"), (3, rows[3][1]), (60, "Z z Z")]
    targets = {1, 2, 3, 60}
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    marks = spark.createDataFrame([(t,) for t in [*targets, 1, None, 999]], "doc_id long")
    model = lm_score.train(docs, marks, most)
    found = sorted(map(tuple, lm_score.score(docs, marks, model).collect()), key=str)
    want = sorted(plain(rows, targets, most, lm_score.BACKING, lm_score.SLOTS), key=str)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:2] == b[:2] and all(x is None and y is None or abs(x - y) < 1e-6 for x, y in zip(a[2:], b[2:])), (a, b)


def test_in_domain_text_scores_lower(spark):
    rnd = random.Random(1)
    make = lambda words: " ".join(rnd.choices(words, k=60))
    one, two = [f"x{k}" for k in range(30)], [f"y{k}" for k in range(30)]
    rows = [(k, make(one if k % 2 else two)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = docs.where("doc_id % 2 = 1 and doc_id < 60").select("doc_id")
    found = lm_score.score(docs, marks, lm_score.train(docs, marks)).toPandas().set_index("doc_id").score
    assert found[found.index % 2 == 1].max() < found[found.index % 2 == 0].min()


def test_small_steps_give_the_same(spark, monkeypatch):
    texts = ["a b c", None, "d " * 50, "a b"]
    whole = [np.concatenate(x).tolist() for x in zip(*lm_score.numbered(texts, {b"a": 1, b"d": 2}))]
    monkeypatch.setattr(lm_score, "STEP", 2)
    assert [np.concatenate(x).tolist() for x in zip(*lm_score.numbered(texts, {b"a": 1, b"d": 2}))] == whole


def test_empty_and_without_targets(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.score(docs.limit(0), none, lm_score.train(docs.limit(0), none)).collect() == []
    r = lm_score.score(docs, none, lm_score.train(docs, none)).first()
    assert r.n_tokens == 2 and abs(r.score) < 1e-9


@pytest.mark.parametrize("common, slots", [(0, 0), (3, 2), (lm_score.COMMON, lm_score.SLOTS)])
def test_every_word_and_pair_counts_by_itself(spark, common, slots):
    """More words than any fixed vocabulary, and rare ones that meet only where their rows are joined."""
    rnd = random.Random(5)
    rows = [(k, " ".join([*(f"w{rnd.randrange(60000)}" for _ in range(9000)), *rnd.choices("a b c".split(), k=50)])) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = docs.where("doc_id < 4").select("doc_id")
    model = lm_score.train(docs, marks, common=common, slots=slots)
    assert model.size == len({w for _, t in rows for w in t.split()}) + 2 > 40000
    want = plain(rows, set(range(4)), 10**9, lm_score.BACKING, None)
    found = sorted(map(tuple, lm_score.score(docs, marks, model).collect()))
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:2] == b[:2] and all(abs(x - y) < 1e-6 for x, y in zip(a[2:], b[2:])), (a, b)
