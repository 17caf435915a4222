import numpy as np
import pandas as pd
import pytest

from wireloom.llm import ann


def brute(rows, top=20, every=20):
    """rows of (id, vector): per query row the nearest other rows of its length by inner product, ties to the smaller id; by id a list, all of its rows' answers in order."""
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good.sort(key=lambda r: r[0])
    out = {}
    for d in {len(v) for _, v in good}:
        ids = np.array([i for i, v in good if len(v) == d])
        x = np.array([v for _, v in good if len(v) == d])
        for k in np.flatnonzero(ids % every == 0):
            s = (x * x[k]).sum(axis=1)
            out.setdefault(int(ids[k]), []).extend([(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if j != k][:top])
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, want):
    return np.mean([len({i for i, _ in found.get(k, [])} & {i for i, _ in v}) / max(len(v), 1) for k, v in want.items()])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_test_vectors(spark, sf):
    e = pd.read_parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = brute([(int(i), [float(x) for x in v]) for i, v in zip(e.vec_id, e.embedding)])
    found = answers(ann.query(spark, f"/root/testdata/{sf}"))
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert recall(found, want) >= 0.93
    score = {k: dict(v) for k, v in want.items()}
    for k, v in found.items():
        assert all(abs(s - score[k][i]) < 1e-12 for i, s in v if i in score[k])
        assert [(-s, i) for i, s in v] == sorted((-s, i) for i, s in v)


def test_equal_and_near_equal_vectors(spark):
    rnd = np.random.default_rng(1)
    hot = rnd.normal(size=16)
    rows = [(k, (hot if k % 3 == 0 else hot + 0.01 * rnd.normal(size=16) if k % 3 == 1 else rnd.normal(size=16)).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = answers(ann.search(df)), brute(rows)
    assert found.keys() == want.keys()
    assert recall(found, want) >= 0.9


def test_small_tables_are_exact(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [0.5, 3.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [-1.0, 0.0])]
    odd = [(4, None), (60, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, rank int")
    assert answers(ann.search(df)) == brute(rows)
    assert ann.search(df.limit(0)).collect() == []
    assert answers(ann.search(df.where("vec_id = 20"))) == {}


def test_repeated_ids_and_other_lengths(spark):
    """Every row but the query's own is a candidate; vectors of another length are searched among themselves."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (40, [1.0, 1.0, 1.0]), (2, [2.0, 0.0, 1.0]), (3, [-1.0] * 3), (60, [5.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(i, v, s) for i, each in brute(rows).items() for v, s in each]
    assert sorted((r.query_id, r.vec_id, r.score) for r in found) == sorted(want) and len(found) == 3 * 4 + 2
    assert sorted(r["rank"] for r in found) == [1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_queries_far_from_all_go_on(spark, monkeypatch):
    """A query whose probed lists hold few rows still gets its 20."""
    rnd = np.random.default_rng(3)
    far = [(20 * k, (100 * np.eye(8)[k % 8] + rnd.normal(size=8)).tolist()) for k in range(1, 9)]
    rows = far + [(20 * k + 1, (rnd.normal(size=8) * 0.1).tolist()) for k in range(2000)]
    real = ann.fit

    def narrow(x, n):
        index = real(x, n)
        index.probes = 1
        return index

    monkeypatch.setattr(ann, "fit", narrow)
    found = answers(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert set(found) == {i for i, _ in far} and all(len(v) == 20 for v in found.values())


def test_finer_lists(spark, monkeypatch):
    """More lists than the sample can fit centroids for."""
    monkeypatch.setattr(ann, "LISTS", 8)
    rnd = np.random.default_rng(6)
    centers = rnd.normal(size=(40, 16))
    rows = [(k, (centers[k % 40] + 0.2 * rnd.normal(size=16)).tolist()) for k in range(4000)]
    assert len(ann.fit(np.array([v for _, v in rows]), 4000).finer) == 63 // 8
    assert recall(answers(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(rows)) >= 0.93


def test_recall_on_fifty_thousand_vectors(spark):
    e = pd.read_parquet("/root/testdata/check_l/embeddings.parquet")
    x, ids = np.array(e.embedding.tolist(), dtype=float), e.vec_id.to_numpy()
    assert len(ids) > 50_000
    found = answers(ann.query(spark, "/root/testdata/check_l"))
    some = np.flatnonzero(ids % 20 == 0)[::8]
    hits = 0
    for k in some:
        s = x @ x[k]
        s[k] = -np.inf
        hits += len({int(i) for i in ids[np.lexsort((ids, -s))[:20]]} & {i for i, _ in found[ids[k]]})
    assert hits / (20 * len(some)) >= 0.95


def test_blocks_give_the_same(spark, monkeypatch):
    """Lists of more rows than a block, and bundles of more queries, are dealt out without change."""
    rnd = np.random.default_rng(4)
    rows = [(k, rnd.normal(size=8).tolist() if k % 3 else [1.0, 2.0] * 4) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = answers(ann.search(df))
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "STEP", 500)
    found = answers(ann.search(df))
    want = brute(rows)
    assert found.keys() == whole.keys() == want.keys() and recall(found, want) >= 0.93 and recall(whole, want) >= 0.93
    assert ann.bundles(np.array([5, 0, 3, 9, 1, 1]), 8)[0].tolist() == [0, 0, 0, 1, 2, 2] and ann.bundles(np.array([5, 0, 3, 9, 1, 1]), 8)[1].tolist() == [1, 2, 1]
