import re

import numpy as np
import pandas as pd
import pytest

from wireloom.llm import features, quality, toxicity
from wireloom.llm.features import Grams, Rows, grams, platt, present, score, sigmoid, sparse
from wireloom.llm.sample import labelled

DATA = "/root/testdata/sf0.1"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


@pytest.mark.parametrize("long", [1 << 22, -1])
def test_counts_match_the_definition(monkeypatch, long):
    monkeypatch.setattr(quality, "LONG", long)
    texts = [None, "", " ", "one two", "a b c a b c", "a b c d a b c e a b c", "x\nx\n \n\nx ", "é\x1c# <b>\x0b\x0c *", "a a a a a", "w " * 60, " ".join(map(str, range(60)))]
    texts += pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist()[:120]
    texts = [t for t in texts if len(t or "") < 8000]
    assert [quality.counts(t) for t in texts] == [plain_counts(t) for t in texts]


def test_grams_are_counted_within_their_text():
    spec = Grams(words=(1, 2), chars=(3,), bits=30)
    texts = ["ab cd ab", "", "x", "ab cd", "  ab  cd  ", "abcd"]
    found = [(b, bounds) for b, bounds in grams(texts, spec)]
    one = [[b[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] for b, bounds in found]
    assert [list(map(len, f)) for f in one] == [[3, 0, 1, 2, 2, 1], [2, 0, 0, 1, 1, 0], [6, 0, 0, 3, 8, 2]]
    assert one[0][0][0] == one[0][0][2] == one[0][3][0] == one[0][4][0] and one[1][0][0] == one[1][3][0] == one[1][4][0]
    assert one[2][0][0] == one[2][3][0] and one[0][5] != one[0][0][:1]


def test_scores_agree_with_sparse_rows():
    spec, rnd = Grams(bits=16), np.random.default_rng(1)
    table = rnd.normal(size=1 << 16)
    texts = ["some words, and some more words", None, "x", "ABC abc " * 50, "é日本 text"]
    want = []
    for t in texts:
        at, value = sparse(t, spec)
        want.append(float((table[at] * value).sum()))
    assert np.allclose(score(texts, spec, [table])[:, 0], want, atol=1e-4)


def test_presence():
    spec = Grams(words=(1,), chars=(), bits=40, letters=True, presence=True)
    at, _ = sparse("bad worse", spec)
    weights = np.array([[1.0], [10.0]])
    assert present(["Bad! bad, good", "none", None, "worse-bad"], spec, at, weights)[:, 0].tolist() == [float(weights[list(at).index(sparse("bad", spec)[0][0]), 0]), 0, 0, 11.0]


def test_platt_is_monotone_and_bounded():
    z = np.concatenate((np.linspace(-9, -1, 90), np.linspace(1, 9, 30)))
    a, b = platt(z, (z > 0).astype(int))
    assert a > 0 and sigmoid(a * -1 + b) < 0.5 < sigmoid(a * 1 + b)
    assert platt(z, np.ones(len(z))) == (1.0, 0.0)


def held_out(spark, label):
    """Documents and labels for training and, of other ids, for judging."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas().set_index("doc_id")[label]


def test_quality_on_held_out_rows(spark):
    docs, train, test = held_out(spark, "quality")
    found = quality.judge(docs, quality.train(docs, train)).toPandas().set_index("doc_id")
    assert len(found) == docs.count()
    both = found.join(test, rsuffix="_label", how="inner")
    rest = both[~both.base_failed]
    assert (rest.kept == (rest.quality_label == 1)).mean() > 0.99
    assert not both[both.base_failed].kept.any()


def test_toxicity_on_held_out_rows(spark):
    """Some of these labels are noise: a few rows labelled toxic hold nothing that clean rows don't."""
    docs, train, test = held_out(spark, "toxic")
    found = toxicity.judge(docs, toxicity.train(docs, train)).toPandas().set_index("doc_id")
    both = found.join(test, rsuffix="_label", how="inner")
    assert both[both.toxic_label == 1].toxic.mean() > 0.85
    assert both[both.toxic_label == 0].toxic.mean() < 0.01


def test_unseen_endings_of_toxic_stems(spark):
    rnd = np.random.default_rng(3)
    clean, endings = [f"{a}{b}er" for a in "bdfgklmnprst" for b in ("al", "en", "ir", "or", "ul")], ["a", "en", "ung", "heit", "lich", "sam", "bar"]
    make = lambda bad: " ".join(rnd.choice(clean, 60).tolist() + [f"zwock{e}" for e in bad])
    rows = [(k, make(rnd.choice(endings[:4], 2)) if k % 8 == 0 else make([])) for k in range(800)]
    docs = spark.createDataFrame([*rows, (9000, make(endings[5:])), (9001, make([]))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k, _ in rows], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.toxic for r in toxicity.judge(docs, toxicity.train(docs, labels)).collect()}
    assert found[9000] and not found[9001] and sum(found.values()) == 101


def test_later_models_see_earlier_probabilities(spark):
    docs, train, _ = held_out(spark, "toxic")
    chain = toxicity.train(docs, train)
    assert [len(x[0]) for x in chain.links] == [0, 1, 2]
    assert all(u > 0 for u in chain.links[2][0])


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(None, 1, 1), (1, None, None)]])
def test_without_two_classes(spark, rows):
    docs = spark.createDataFrame([(1, "good words " * 60, "x"), (1, "good words " * 60, "x"), (2, None, "x"), (None, "a b", "x"), (3, " ".join(map(str, range(80))), "x")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = quality.judge(docs, quality.train(docs, labels)).collect()
    assert sorted((str(r.doc_id), r.kept) for r in found) == [("1", False), ("1", False), ("2", False), ("3", True), ("None", False)]
    assert not any(r.toxic for r in toxicity.judge(docs, toxicity.train(docs, labels)).collect())
    assert quality.keep(docs, quality.train(docs, labels)).columns == docs.columns
    assert quality.judge(docs.limit(0), quality.train(docs, labels)).collect() == []
    assert toxicity.drop(docs.limit(0), toxicity.train(docs, labels)).collect() == []


def test_repeated_labels_and_documents(spark):
    good, bad = " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}$$$" for k in range(80))
    docs = spark.createDataFrame([(k, good if k % 2 else bad) for k in range(60) for _ in range(2)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60) for _ in range(3)], "doc_id long, quality int, toxic int")
    found = quality.judge(docs, quality.train(docs, labels)).collect()
    assert len(found) == 120 and all(r.kept == bool(r.doc_id % 2) for r in found)


@pytest.mark.parametrize("spec", [Grams(), Grams(words=(1, 2, 3), chars=(1, 4), bits=40, starts=(3,), letters=True), Grams(words=(1,), chars=(), bits=40, starts=(2, 3), letters=True, presence=True), Grams(words=(2,), chars=(5,), bits=40)])
def test_pieces_have_the_n_grams_of_the_whole(monkeypatch, spec):
    """Wherever a long text is cut, also within long words and white space."""
    rnd = np.random.default_rng(4)
    texts = ["", "x" * 100, " " * 200 + "end", "ab " + "y" * 57 + " cd" + " " * 90 + "ef gh", "worthless, " * 30, "a" * 33 + "b," * 40]
    texts += ["".join(rnd.choice(list("abc ,\né"), n)) for n in (30, 41, 80, 400, 999)] + ["".join(rnd.choice(["a", "bcd", " ", "      ", "efghijklmnop", ","], 60)) for _ in range(30)]
    monkeypatch.setattr(features, "WORD", 8)
    table = rnd.normal(size=1 << 18)
    whole = [sparse(t, spec) for t in texts]
    sums = score(texts, spec, [table]) if spec.bits == 18 else None
    some = np.unique(np.concatenate([at for at, _ in whole]))[::3]
    weights = rnd.normal(size=(len(some), 2))
    held = present(texts, spec, some, weights)
    for piece in (16, 23, 40):
        monkeypatch.setattr(features, "PIECE", piece)
        for (at, value), (at_, value_) in zip(whole, [sparse(t, spec) for t in texts]):
            assert at.tolist() == at_.tolist() and np.allclose(value, value_)
        if sums is not None:
            assert np.allclose(sums, score(texts, spec, [table]))
        assert np.allclose(held, present(texts, spec, some, weights))


def test_very_long_texts(spark):
    """Texts of many pieces, one of them a single word."""
    long = "worthless words here, " * 40000
    assert len(long) > 3 * features.PIECE
    docs = spark.createDataFrame([(1, long), (2, "x" * 300_000), (3, long[:-3])], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in quality.judge(docs, quality.train(docs, labels)).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in toxicity.judge(docs, toxicity.train(docs, labels)).collect()) == [1, 2, 3]
    at, value = sparse(long, Grams(words=(1, 2), chars=(), bits=40))
    assert len(at) == 6 and np.isclose((value**2).sum(), 3 * 40000**2 / 120000 + (2 * 40000**2 + 39999**2) / 119999)


def test_windows_of_long_texts_are_compared_by_words():
    for text in ["", "a", "a b", "a b c a b c", "a a a a", "a b c d a b c e a b c", " ".join(map(str, range(300))) + " 1 2 3"]:
        words = text.split()
        assert quality.repeated_in_long(text) == (len(words), quality.repeated_in([w.encode() for w in words]))


def test_sample_is_bounded_before_it_is_collected(spark):
    """Labels of ids that the input lacks take no place; a repeated id counts once, with its least text."""
    docs = spark.createDataFrame([(5, "b"), *[(5, "a b"), (5, None)] * 50, (7, None), (None, "x"), (9, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1000)] + [(5, 0), (None, 1), (9, None)], "doc_id long, y int")
    spec = Grams(words=(1,), chars=(), bits=40)
    ids, at, _, y = labelled(docs, labels, "y", spec, 3)
    assert ids.tolist() == [5, 7, 9] and y.tolist() == [1, 1, 1] and list(map(len, at)) == [2, 0, 2]
    assert at[0].tolist() == sparse("a b", spec)[0].tolist()
    assert len(labelled(docs, labels, "y", spec, 2)[0]) == 2
    assert labelled(docs.limit(0), labels, "y", spec, 3)[0].tolist() == []


def test_kinds_are_clusters_of_the_toxic_rows():
    spec, rnd = toxicity.SPEC, np.random.default_rng(2)
    clean = lambda: rnd.choice([f"{a}{b}" for a in "bdfgkl" for b in ("alo", "ene", "iri")], 20).tolist()
    texts = [" ".join(clean() + (["zwock", "zwerg"] if k % 10 == 0 else ["qualm", "quark"] if k % 10 == 5 else [])) for k in range(400)]
    rows = Rows(*zip(*(sparse(t, spec) for t in texts)))
    found = toxicity.kinds(rows, np.arange(400) % 5 == 0)
    assert sorted(np.flatnonzero(f)[0] for f in found) == [0, 5] and [f.sum() for f in found] == [40, 40]
    assert [k.sum() for k in toxicity.kinds(rows, np.zeros(400, bool))] == [0, 0]


def test_chain_gains_over_one_model(monkeypatch):
    """On held-out rows the chain ranks toxic rows above clean ones more often than a single model of the same sample."""
    docs = pd.read_parquet(f"{DATA}/documents.parquet").drop_duplicates("doc_id").set_index("doc_id").text
    labels = pd.read_parquet(f"{DATA}/labels.parquet").groupby("doc_id").toxic.max()
    train, test = labels[labels.index % 2 == 0], labels[labels.index % 2 == 1]
    rows, toxic = Rows(*zip(*(sparse(docs[i], toxicity.SPEC) for i in train.index))), train.to_numpy() > 0

    def area():
        rank = pd.Series(toxicity.fit(rows, toxic).probabilities([docs[i] for i in test.index])[:, -1]).rank().to_numpy()
        n = int(test.sum())
        return (rank[test.to_numpy() > 0].sum() - n * (n + 1) / 2) / (n * (len(test) - n))

    chain = area()
    monkeypatch.setattr(toxicity, "kinds", lambda rows, toxic: [])
    assert chain > area() + 0.005 and chain > 0.99


def plain_fit(x, y, l2, steps, width=None):
    """The same logistic regression on a dense matrix; width: columns that the penalty is spread over. Weights of columns, then the bias."""
    w, m1, m2 = np.zeros(x.shape[1] + 1), 0.0, 0.0
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(rate / (1 - rate))
    for t in range(1, steps + 1):
        g = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        grad = np.append(x.T @ g / len(y) + l2 * w[:-1] / (width or x.shape[1]), g.mean())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        w = w - 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
    return w


def dense(every, some):
    """A column for each n-gram that four or more of the rows `some` hold; every: per row its n-grams and values."""
    seen = {}
    for i in some:
        for g in every[i]:
            seen[g] = seen.get(g, 0) + 1
    column = {g: k for k, g in enumerate(sorted(g for g, n in seen.items() if n >= 4))}
    x = np.zeros((len(every), len(column)))
    for i, c in enumerate(every):
        for g, v in c.items():
            if g in column:
                x[i, column[g]] = v
    return x


def dealt(y):
    return [np.sort(np.concatenate([np.flatnonzero(y == c)[k::4] for c in (0, 1)])) for k in range(4)]


def plain_quality(texts, some, y):
    """Probabilities of good quality of all texts, from the labelled rows `some` (in order of id) and their labels."""

    def counted(text):
        out, t = {}, (text or "").lower()
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        for family, found in enumerate((ws, [a + " " + b for a, b in zip(ws, ws[1:])], [t[i : i + 3] for i in range(len(t) - 2)])):
            for g in found:
                out[family, g] = out.get((family, g), 0) + 1 / len(found) ** 0.5
        return out

    x, y, z = dense([counted(t) for t in texts], some), np.asarray(y), np.zeros(len(y))
    for held in dealt(y):
        rest = np.setdiff1d(np.arange(len(y)), held)
        w = plain_fit(x[some][rest], y[rest], 2e-3, 80)
        z[held] = x[some][held] @ w[:-1] + w[-1]
    slope, shift = platt(z, y)
    w = plain_fit(x[some], y, 2e-3, 80)
    return sigmoid(slope * (x @ w[:-1] + w[-1]) + shift)


def plain_toxicity(texts, some, y):
    """Probabilities of the chain's last category; only the clusters of toxic rows are the operator's own."""

    def held(text):
        ws = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
        return {(0, w): 1.0 for w in ws} | {(n, w[:n]): 1.0 for w in ws for n in (3, 4, 5, 6) if len(w) >= n}

    x, y = dense([held(t) for t in texts], some), np.asarray(y)
    sparse_rows = [sparse(texts[i], toxicity.SPEC) for i in some]
    targets = [*(k.astype(int) for k in toxicity.kinds(Rows(*zip(*sparse_rows)), y > 0)), y]
    mine, earlier, whole = x[some], np.zeros((len(y), 0)), np.zeros((len(texts), 0))

    def model(rows, target):
        n1, share = max(int(target.sum()), 1), rows.mean(axis=0)
        n0 = max(len(rows) - n1, 1)
        one, zero = rows[target == 1].sum(axis=0) / n1, rows[target == 0].sum(axis=0) / n0
        apart = (one - zero) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
        return np.abs(apart) >= toxicity.LEAST_Z

    for target in targets:
        if len(set(target)) < 2:
            earlier, whole = np.column_stack((earlier, np.full(len(y), target.mean()))), np.column_stack((whole, np.full(len(texts), target.mean())))
            continue
        z = np.zeros(len(y))
        for part in dealt(target):
            rest = np.setdiff1d(np.arange(len(y)), part)
            use = model(mine[rest], target[rest])
            w = plain_fit(np.column_stack((mine[rest][:, use], earlier[rest])), target[rest], 2e-3, toxicity.STEPS, x.shape[1])
            z[part] = np.column_stack((mine[part][:, use], earlier[part])) @ w[:-1] + w[-1]
        slope, shift = platt(z, target)
        use = model(mine, target)
        w = plain_fit(np.column_stack((mine[:, use], earlier)), target, 2e-3, toxicity.STEPS, x.shape[1])
        p = sigmoid(slope * (np.column_stack((x[:, use], whole)) @ w[:-1] + w[-1]) + shift)
        earlier, whole = np.column_stack((earlier, sigmoid(slope * z + shift))), np.column_stack((whole, p))
    return np.where([bool(t and t.strip()) for t in texts], whole[:, -1], 0.0)


def test_quality_verdict_against_a_dense_model(spark):
    """The verdict of a dense matrix of the same n-grams, folds, calibration and threshold, without hashing tables or sums in batches."""
    rnd = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "st", "rk")]
    make = lambda k: " ".join(rnd.choice(words[:40] if k % 2 else words[20:], 60))
    rows = [(k, make(k)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    want = plain_quality([t for _, t in rows], np.arange(80), np.arange(80) % 2)
    found = {r.doc_id: r for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    got = np.array([found[k].quality for k in range(120)])
    assert np.abs(got - want).max() < 0.02  # a few n-grams share a bucket
    assert [found[k].kept for k in range(120)] == [bool(p >= quality.KEEP and not plain_counts(t)[-1]) for (_, t), p in zip(rows, want)]


def test_toxicity_against_dense_models():
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").drop_duplicates("doc_id").set_index("doc_id").text
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").groupby("doc_id").toxic.max()
    labels = labels[labels.index.isin(docs.index)]
    texts, at = [t[:20000] for t in docs], {i: k for k, i in enumerate(docs.index)}
    some, y = np.array([at[i] for i in labels.index]), (labels.to_numpy() > 0).astype(int)
    rows = Rows(*zip(*(sparse(texts[i], toxicity.SPEC) for i in some)))
    got = toxicity.fit(rows, y > 0).probabilities(texts)[:, -1]
    assert np.abs(got - plain_toxicity(texts, some, y)).max() < 1e-3
