import random

import duckdb
import pytest

from wireloom.llm import url_filter as U


def plain(captures, entries):
    last = {}
    for pattern, category, day, adds, seq in entries:
        if pattern is not None and day is not None:
            last[pattern, day] = max(last.get((pattern, day), (-1,)), (seq, adds, category))
    out = []
    for i, host, part, day in captures:
        labels = host.split(".") if host else []
        known = [".".join(labels[k:]) for k in range(max(len(labels) - 1, 1))] if labels else []
        known += [f"{host}/{part}"] if host and part else []
        active = []
        for p in known:
            days = [d for q, d in last if q == p and day is not None and d <= day]
            if days and last[p, max(days)][1]:
                active.append((len(p), p, last[p, max(days)][2], max(days)))
        best = max(active, default=(0, None, None, None))
        out.append((i, host, len(active), *best[1:], bool(active)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 7, 30])
def test_as_of_each_day(spark, seed):
    rnd = random.Random(seed)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "localhost", ""]
    patterns = ["a.com", "b.a.com", "c.b.a.com", "x.org", "a.com/p", "b.a.com/q", "localhost", "com", None]
    captures = [(k, rnd.choice(hosts), rnd.choice(["p", "q", ""]), rnd.choice([None, *range(100, 140)])) for k in range(400)]
    entries = [(rnd.choice(patterns), rnd.choice(["spam", "bad"]), rnd.choice([None, *range(90, 150)]), rnd.random() < 0.6, k) for k in range(60)]
    rows = [(i, f"http://{h.upper()}:80/{p}/x?y" if h else "no url", d, "extra") for i, h, p, d in captures]
    df = spark.createDataFrame(rows, "page_id long, url string, day long, extra string")
    found = U.evaluate(df, spark.createDataFrame(entries, "pattern string, category string, day long, adds boolean, seq long"))
    assert {"extra", "page_id", "url", "day"} < set(found.columns)
    got = sorted(((r.page_id, r.host, r.n_active, r.pattern, r.category, r.listed_on, r.blocked) for r in found.collect()), key=str)
    # a URL without a host has no path part either
    assert got == plain([(i, h, p if h else "", d) for i, h, p, d in captures], entries)


def test_parts_of_urls(spark):
    urls = ["http://A.B.com./x/y", "https://u:p@h.org:8080?z", "ftp://h.org", "h.org/x", None, "", "http:///x", "http://h.org/#f"]
    rows = U.keyed(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert [(r.host, r.part) for r in rows] == [("a.b.com", "x"), ("h.org", ""), ("h.org", ""), ("", ""), ("", ""), ("", ""), ("", "x"), ("h.org", "")]


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = U.query(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = con.execute(U.SQL)
    names = [d[0] for d in got.description]
    want = sorted(got.fetchall(), key=str)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False}


def test_no_python_in_the_plan(spark):
    plan = U.query(spark, "/root/testdata/sf0.01")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, day long")
    entries = spark.createDataFrame([], "pattern string, category string, day long, adds boolean, seq long")
    assert U.evaluate(df, entries).collect() == []
    one = spark.createDataFrame([(1, "http://a.com", 5), (1, "http://a.com", 5)], "page_id long, url string, day long")
    assert [r.blocked for r in U.evaluate(one, entries).collect()] == [False, False]


def test_clashing_columns_and_far_days(spark):
    """Captures' columns named as results go, others stay whatever their name; days far apart and long hosts cost no more."""
    far = ".".join(f"l{k}" for k in range(300)) + ".a.com"
    rows = [(k, url, day, "own", "own", "own", "own", "own") for k, (url, day) in enumerate([("http://a.com/x", 5), (f"http://{far}/", 2_900_000), ("http://b.com", -7), (None, 5), ("http://a.com", None)])]
    names = ["id", "url", "day", "category", "host", "part", "best", "i"]
    df = spark.createDataFrame(rows, "id long, url string, day int, category string, host string, part string, best string, i string").toDF(*names)
    entries = [("a.com", "spam", 0, True, 1), ("l299.a.com", "bad", 10, True, 1), ("l299.a.com", "bad", 2_900_001, False, 2), ("b.com", "spam", -6, True, 1)]
    found = U.evaluate(df, spark.createDataFrame(entries, "pattern string, category string, day long, adds boolean, seq long"))
    assert found.columns == ["id", "url", "day", "part", "best", "i", *U.RESULT]
    got = {r.id: (r.part, r.best, r.i, r.host, r.n_active, r.pattern, r.category, r.listed_on, r.blocked) for r in found.collect()}
    own = ("own", "own", "own")
    assert got == {0: (*own, "a.com", 1, "a.com", "spam", 0, True), 1: (*own, far, 2, "l299.a.com", "bad", 10, True), 2: (*own, "b.com", 0, None, None, None, False), 3: (*own, "", 0, None, None, None, False), 4: (*own, "a.com", 0, None, None, None, False)}
