import random

import pytest
import xxhash

from wireloom.llm import simhash


def plain_fingerprint(text, size=3):
    words, at = [], ""
    for c in (text or "") + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words, at = (words + [at] if at else words), ""
        else:
            at += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows of (id, fingerprint): the smallest id reachable over at most 2 differing bits, by comparing all."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(rows))]


def test_fingerprints_match_the_definition():
    texts = [None, "", " \n", "one", "One two", "A b c", "a b c a b c a b c", "Ä b C d e", "x\x1cy z \x0b q", "é " * 50, "w" * 3000]
    texts += [" ".join(random.Random(k).choices("abcdef", k=40)) for k in range(20)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_long_texts_have_the_same_fingerprints(monkeypatch):
    texts = ["", " \n", "One", "one two", "A b c", "a b c a b c a b c", "é " * 50, " ".join(map(str, range(200)))]
    monkeypatch.setattr(simhash, "LONG", -1)
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_manhattan_distance_in_unary_code(spark):
    rnd = random.Random(1)
    values = [rnd.getrandbits(64) for _ in range(50)] + [0, (1 << 64) - 1]
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    codes = [r.e % (1 << 64) for r in df.select(simhash.embedding(df.fp).alias("e")).collect()]
    for v, c in zip(values, codes):
        for w, d in zip(values, codes):
            counts = sum(abs((v >> k & 3).bit_count() - (w >> k & 3).bit_count()) for k in range(0, 64, 2))
            assert (c ^ d).bit_count() == counts <= (v ^ w).bit_count()


@pytest.mark.parametrize("cell", [0, 2, 32])
def test_links_connect_what_brute_force_connects(spark, cell):
    rnd = random.Random(cell)
    values = set()
    for _ in range(12):  # chains and balls around random centres
        v = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 40])):
            values.add(v)
            v ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                v ^= 1 << rnd.randrange(64)
    values = sorted(values)
    found = simhash.links(spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long"), cell).collect()
    root = {simhash.signed(v): simhash.signed(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 2
        root[find(r.a)] = find(r.b)
    groups = plain_components(list(enumerate(values)))
    ours = {}
    for k, v in enumerate(values):
        ours.setdefault(find(simhash.signed(v)), []).append(k)
    assert sorted(map(tuple, ours.values())) == sorted(tuple(k for k, g in enumerate(groups) if g == x) for x in set(groups))


def test_groups_of_documents(spark):
    rnd = random.Random(7)
    base = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], k=300)) for _ in range(30)]
    rows = [(k, t, "x") for k, t in enumerate(base)]
    rows += [(100 + k, t + " tail", "x") for k, t in enumerate(base)] + [(200 + k, base[0], "x") for k in range(60)]
    rows += [(300, None, "x"), (301, "", "x"), (302, " \t", "x"), (5, base[5], "x"), (None, base[6], "x"), (None, "lonely words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")
    found = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in simhash.grouped(docs).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    assert found == dict(zip(prints, plain_components(prints)))


def test_stage_keeps_one_of_each_group(spark):
    rows = [(1, "some words for a text"), (2, "some words for a text"), (2, "some words for a text"), (3, "quite other words in here"), (3, "quite other words in here"), (None, "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]


def test_stage_decides_by_row(spark):
    """An id with two unrelated texts, one of them a copy of a smaller id, and copies without an id."""
    rows = [(1, "some words for a text"), (2, "some words for a text"), (2, "quite other words in here"), (3, "first of two texts"), (3, "the second one differs")]
    rows += [(None, "no id at all")] * 2 + [(None, "some words for a text")]
    kept = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], *rows[2:6]], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.grouped(docs).collect() == []
    assert simhash.stage(spark, docs, "").collect() == []


@pytest.mark.parametrize("turn", [False, True])
def test_stage_keeps_the_unique_text_of_a_repeated_id(spark, turn):
    """In either order of rows, also with columns named as the stage's own."""
    texts = "some words for a text", "quite other words in here"
    rows = [(1, texts[0], "x", "y", 0, 1), (5, texts[0], "x", "y", 0, 2), (5, texts[1], "x", "y", 0, 3)]
    df = spark.createDataFrame(rows[:1] + rows[1:][:: -1 if turn else 1], "doc_id long, text string, fp string, doc string, none int, DOC_ID2 int").coalesce(1)
    found = simhash.stage(spark, df, "")
    assert found.columns == df.columns and sorted(map(tuple, found.collect())) == [rows[0], rows[2]]


def test_stage_moves_rows_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = simhash.stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert sum("text" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line) <= 1, plan


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        simhash.kept.__globals__["folder"](Session())
