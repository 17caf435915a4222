import math
import random

import pytest
from pyspark.sql import functions as F

from wireloom.functions import geometry as G
from wireloom.functions import text as T
from wireloom.operators import boxes, evidence, graph, matching, runs, specialists, text
from wireloom.plans import evaluate
from wireloom.sources import domains

BOX = "drawing_id long, idx int, x0 int, y0 int, x1 int, y1 int"


def made(spark, rows, more=""):
    return spark.createDataFrame(rows, BOX + more)


def random_boxes(seed, n, drawings=3, side=900):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rnd.randint(-50, side), rnd.randint(-50, side)
        out.append((rnd.randrange(drawings), k, x, y, x + rnd.randint(0, 300), y + rnd.randint(0, 120)))
    return out


def area(a):
    return (a[4] - a[2]) * (a[5] - a[3])


def common(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    return w * h if w > 0 and h > 0 else 0


def apart(a, b):
    dx, dy = max(b[2] - a[4], a[2] - b[4], 0), max(b[3] - a[5], a[3] - b[5], 0)
    if dx == dy == 0:
        return math.hypot((a[2] + a[4] - b[2] - b[4]) / 2, (a[3] + a[5] - b[3] - b[5]) / 2)
    return math.hypot(dx, dy)


@pytest.mark.parametrize("cell", [16, 256, 5000])
def test_grid_joins_find_every_pair_once(spark, monkeypatch, cell):
    monkeypatch.setattr(boxes, "CELL", cell)
    monkeypatch.setattr(boxes.meeting, "__defaults__", (0, cell, None))
    a, b = random_boxes(1, 120), random_boxes(2, 120)
    got = sorted((r.drawing_id, r.a_idx, r.b_idx) for r in boxes.iou_pairs(made(spark, a), made(spark, b), 0.2).collect())
    assert got == sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and (s := common(p, q)) and s / (area(p) + area(q) - s) >= 0.2)
    got = sorted((r.drawing_id, r.a_idx, r.b_idx) for r in boxes.near_tokens(made(spark, a), made(spark, b)).collect())
    assert got == sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and apart(p, q) <= 45)
    got = sorted((r.a_idx, r.b_idx) for r in boxes.overlapping(made(spark, a)).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in a if p[0] == q[0] and p[1] < q[1] and min(area(p), area(q)) and common(p, q) / min(area(p), area(q)) >= 0.5)


def test_touching_nested_and_empty_boxes(spark):
    rows = [(1, 0, 0, 0, 10, 10), (1, 1, 10, 0, 20, 10), (1, 2, 2, 2, 4, 4), (1, 3, 50, 50, 50, 60), (2, 4, 0, 0, 10, 10)]
    df = made(spark, rows)
    assert [(r.a_idx, r.b_idx) for r in boxes.overlapping(df).collect()] == [(0, 2)]
    # a label inside a large box is as far as its centre is
    big = made(spark, [(1, 0, 0, 0, 200, 200)])
    labels = made(spark, [(1, 0, 0, 0, 10, 10), (1, 1, 200, 50, 210, 60), (1, 2, 95, 95, 105, 105)])
    assert sorted(r.b_idx for r in boxes.near_tokens(big, labels).collect()) == [2]


def sequential(pairs):
    left, right, out = set(), set(), []
    for o, a, b in sorted(pairs):
        if a not in left and b not in right:
            left.add(a), right.add(b), out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_rounds_equal_the_sequence(spark, seed):
    rnd = random.Random(seed)
    pairs = list({(a, b): (rnd.randint(0, 4), a, b) for a, b in ((rnd.randrange(12), rnd.randrange(12)) for _ in range(60))}.values())
    df = spark.createDataFrame(pairs, "o int, a int, b int").repartition(3)
    got = matching.greedy(df, ["a"], ["b"], [F.col(c) for c in ("o", "a", "b")])
    assert sorted((r.a, r.b) for r in got.collect()) == sequential(pairs)


def test_perfect_and_contested_predictions(spark):
    rows = [(d, k, 40 * k, 0, 40 * k + 30, 30, "R") for d in (1, 2) for k in range(3)]
    gold = made(spark, rows, ", type string")
    found = evaluate.matches(gold, gold)
    total = evaluate.detection(gold, gold, found).where("scope = 'TOTAL'").first()
    assert (total.tp, total.fp, total.fn, total.f1, total.accuracy) == (6, 0, 0, 1.0, 1.0)
    two = made(spark, [(1, 0, 0, 0, 30, 30, "R"), (1, 1, 1, 0, 31, 30, "C")], ", type string")
    one = made(spark, [(1, 0, 0, 0, 30, 30, "L")], ", type string")
    report = {r.scope: r for r in evaluate.detection(two, one, evaluate.matches(two, one)).collect()}
    assert (report["1"].tp, report["1"].fp, report["1"].fn, report["1"].correct, report["1"].accuracy) == (1, 0, 1, 0, 0.0)


def test_connectivity_counts_matched_ends_only(spark):
    edges = lambda rows: spark.createDataFrame(rows, "drawing_id long, a int, b int")
    found = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7)], "drawing_id long, gi int, pi int")
    got = evaluate.connectivity(edges([(1, 0, 1), (1, 1, 0), (1, 1, 2), (1, 2, 9)]), edges([(1, 6, 5), (1, 5, 7), (1, 7, 99)]), found)
    r = got.where("scope = 'TOTAL'").first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1)


def merge(rows, least=0.5):
    full = [{"drawing_id": 1, "idx": k, "x0": a, "y0": b, "x1": c, "y1": d, "kind": "symbol", "class": None, "confidence": None, "source": "density"} for k, (a, b, c, d) in enumerate(rows)]
    return [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in matching.merge_boxes(full, least)]


def test_merge_depends_on_the_order():
    import itertools

    rows = [(7, 9, 14, 15), (2, 2, 14, 4), (5, 8, 14, 19), (1, 5, 11, 16)]
    assert {len(merge(p)) for p in itertools.permutations(rows)} == {2, 3}


def test_merge_keeps_classes_and_sources(spark):
    rows = [
        (1, 0, 0, 0, 10, 10, "symbol", None, 0.9, "real_detector"), (1, 1, 1, 1, 9, 9, "symbol", "R", 0.3, "synthetic_yolo"), (1, 2, 100, 0, 110, 10, "symbol", "C", 0.4, "synthetic_yolo"),
        (1, 3, 100, 0, 110, 10, "ambiguous", "L", 0.4, "synthetic_yolo"), (2, 0, 0, 0, 10, 10, "symbol", None, None, "density"),
    ]
    df = made(spark, rows, ", kind string, class string, confidence double, source string").repartition(4)
    got = sorted(map(tuple, matching.merged(df).collect()))
    assert got == [
        (1, 0, 0, 0, 10, 10, "symbol", "R", 0.3, "synthetic_yolo+real_detector"), (1, 1, 100, 0, 110, 10, "ambiguous", "C", 0.4, "synthetic_yolo"),
        (2, 0, 0, 0, 10, 10, "symbol", None, None, "density"),
    ]


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_turned_boxes_come_back(spark, turn):
    # a 7 by 5 page; the box's pixels turned clockwise, found again
    w, h, b = 7, 5, (1, 2, 4, 3)
    pixels = [(x, y) for x in range(b[0], b[2]) for y in range(b[1], b[3])]
    for _ in range(turn // 90):
        pixels, (w, h) = [(h - 1 - y, x) for x, y in pixels], (h, w)
    xs, ys = zip(*pixels)
    df = made(spark, [(1, 0, min(xs), min(ys), max(xs) + 1, max(ys) + 1)])
    assert tuple(df.select(*G.unrotated(G.Box(), F.lit(turn), F.lit(7), F.lit(5))).first()) == b


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert [get(G.placed(F.lit(f), F.lit(0), F.lit(1))) for f in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert get(G.direction(F.lit(0), F.lit(0))) is None and get(G.direction(F.lit(0), F.lit(-2))) == -90
    assert get(G.turn_between(F.lit(350.0), F.lit(10.0))) == 20 and get(G.turn_between(F.lit(0.0), F.lit(180.0))) == 180
    assert [get(c) for c in G.rates(F.lit(0), F.lit(0), F.lit(0))] == [0, 0, 0]
    assert [get(c) for c in G.from_center(F.lit(-0.5), F.lit(5.0), F.lit(1.0), F.lit(3.0))] == [-1, 3, 0, 6]
    x, y, r = G.circle_through(*[(F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0))])
    assert abs(get(x)) < 1e-9 and abs(get(y)) < 1e-9 and abs(get(r) - 1) < 1e-9
    assert get(G.circle_through(*[(F.lit(a), F.lit(0.0)) for a in (0.0, 1.0, 2.0)])[0]) is None
    with pytest.raises(Exception, match="quarter"):
        get(G.turned(F.lit(1), F.lit(1), F.lit(3), F.lit(3), F.lit(45))[0])
    assert [get(T.normalized(F.lit(t))) for t in ("R 6", "$1", "zd-1", "a_b.c")] == ["R6", "S1", "ZD1", "ABC"]
    assert [get(T.is_value(F.lit(t))) for t in ("10K", "3.3", ".001", "R1", "50uH", "1Kµ")] == [True, True, False, False, True, True]
    assert [get(T.is_id(F.lit(t))) for t in ("R1", "MPSH11", "MPSH1234", "XTALS1", "1R")] == [True, True, False, False, False]


@pytest.mark.parametrize(
    "hint, want",
    [
        ("= ae R6", [("designator", "Resistor")]), ("T2BC547", [("exact_part_number", "BJT_NPN")]), ("R 6", []), ("$1", [("designator", "Switch")]),
        ("RESIST1", [("designator", "Resistor")]), ("10K", []), ("", []), ("TP2 C3", [("designator", "Capacitor"), ("designator", "Capacitor_Polarized")]),
        ("R1 1N4 148", [("exact_part_number", "Diode")]), ("U1 BATT2 X9", [("designator", "Battery")]), ("1n4733", [("exact_part_number", "Zener")]),
    ],
)
def test_text_evidence(spark, hint, want):
    pack = domains.load("electronic")
    got = text.text_evidence(spark.createDataFrame([(1, hint)], "k int, text string"), domains.prefix_table(spark, pack), pack.families, ["k"])
    assert sorted((r.level, r["class"]) for r in got.collect()) == want


def test_prefixes_mean_different_things(spark):
    of = lambda name: {r.prefix: r["class"] for r in domains.prefix_table(spark, domains.load(name)).where("prefix in ('K', 'T')").collect()}
    assert of("electronic") == {"K": "Relay"} and of("pid") == {"K": "Compressor", "T": "Vessel"}
    with pytest.raises(ValueError, match="electronic, pid"):
        domains.load("none")


def test_router(spark):
    packs = {n: (list(p.prefixes), p.keywords) for n, p in domains.packs().items()}
    rows = [(1, "10K R1 uF"), (2, "steam inlet FIC101"), (3, ""), (4, None), (5, "R1 PUMP"), (6, "LIC22outlet pump")]
    got = {r.k: (r.electronic, r.pid, r.domain) for r in text.router_scores(spark.createDataFrame(rows, "k int, text string"), packs).collect()}
    assert got == {1: (2, 0, "electronic"), 2: (0, 3, "pid"), 3: (0, 0, "electronic"), 4: (0, 0, "electronic"), 5: (1, 1, "electronic"), 6: (0, 3, "pid")}


def votes(spark, rows):
    return spark.createDataFrame(rows, "k int, source string, source_ord int, class_ord int, class string, score double, confidence double")


def test_fusion(spark):
    rows = [
        (1, "yolo", 0, 0, "R", 1.0, 0.5), (1, "text", 1, 0, "C", 0.5, 0.6), (1, "text", 1, 1, "L", 0.5, 0.6), (1, "silent", 2, 0, "Z", 1.0, 0.0),
        (2, "text", 1, 0, "C", 0.5, 0.6), (2, "text", 1, 1, "L", 0.5, 0.6), (3, "silent", 2, 0, "Z", 1.0, 0.0),
    ]
    ranked = evidence.fused(votes(spark, rows), {"yolo": 1.2}, ["k"])
    got = {r.k: (r["class"], round(r.score, 6), round(r.margin, 6), r.top) for r in evidence.winners(spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "k int"), ranked, ["k"]).collect()}
    assert got == {1: ("R", 0.6, 0.5, "R,C,L"), 2: ("C", 0.3, 0.0, "C,L"), 3: ("Unknown", 0.0, 1.0, ""), 4: ("Unknown", 0.0, 1.0, "")}
    groups = [("one", ["R", "X"]), ("two", ["C", "L"])]
    assert {r.k: r.route for r in evidence.routed(ranked, groups, ["k"]).collect()} == {1: "one", 2: "two"}


def test_nearest_classes_may_be_fewer_than_asked(spark):
    rows = [(k, [1.0, k / 1000], 7 if k < 25 else 8) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    near = evidence.nearest(df.where("vec_id = 0").selectExpr("vec_id as query_id", "v"), df, block=1)
    assert [r.vec_id for r in near.orderBy("rank").collect()] == list(range(1, 21))
    got = evidence.best_classes(near, 0.62).collect()
    assert [(r.label, r.above) for r in got] == [(7, True)]


def test_probe_and_templates(spark):
    import numpy as np

    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "query_id long, v array<double>")
    got = evidence.probe(rows, np.eye(2), np.zeros(2), ["a", "b"], 1).collect()
    assert sorted((r.query_id, r["class"], round(r.probability, 4)) for r in got) == [(1, "a", 0.8808), (2, "b", 0.9526)]
    library = spark.createDataFrame([("R", 0, 90, False), ("R", 1, 0, True), ("R", 2, 0, False), ("C", 3, 180, True), ("C", 4, 90, True)], "class string, entry int, turn int, mirrored boolean")
    winners = spark.createDataFrame([(1, "R"), (2, "R"), (3, "C"), (4, "Z")], "k int, class string")
    matched = spark.createDataFrame([(1, "R", 1), (2, "C", 3)], "k int, class string, entry int")
    assert {r.k: r.entry for r in evidence.template_of(winners, matched, library, ["k"]).collect()} == {1: 1, 2: 2, 3: 3, 4: None}


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components_equal_union_find(spark, shape):
    rnd = random.Random(shape)
    n = 300
    pairs = {"path": [(k, k + 1) for k in range(n)], "star": [(0, k) for k in range(1, n)], "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n * 2 // 3)]}[shape]
    rnd.shuffle(pairs)
    root = list(range(n + 1))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(d, a, b) for a, b in pairs for d in (1, 2)], "drawing_id int, a int, b int")
    got = {(r.drawing_id, r.node): r.root for r in graph.roots(df, ["drawing_id"]).collect()}
    assert got == {(d, x): find(x) for p in pairs if p[0] != p[1] for x in p for d in (1, 2)}


def drawn(spark, picture):
    rows = [(1, y, x) for y, line in enumerate(picture) for x, c in enumerate(line) if c != "."]
    dots = [(1, y, x) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "o"]
    return spark.createDataFrame(rows, "drawing_id long, y int, x int"), spark.createDataFrame(dots, "drawing_id long, y int, x int")


CROSS = ["....#....", "....#....", "....#....", "....#....", "#########", "....#....", "....#....", "....#....", "....#...."]
DOTTED = [*CROSS[:4], "####o####", *CROSS[5:]]
TEE = ["#########", "....#....", "....#....", "....#...."]


@pytest.mark.parametrize("picture, sizes", [(CROSS, [6, 6]), (DOTTED, [13]), (TEE, [9]), (["###..###"], [3, 3]), (["#.#"], []), (["#"], [])])
def test_crossings(spark, picture, sizes):
    found = graph.nets(graph.rewired(*drawn(spark, picture)))
    got = [r["count"] for r in found.groupBy("net_ord").count().orderBy("net_ord").collect()]
    assert sorted(got) == sorted(sizes)


def test_opposite_arms():
    arms = [(math.atan2(dy, dx), k) for k, (dy, dx) in enumerate([(-1, 0), (0, 1), (1, 0), (0, -1)])]
    assert sorted(tuple(sorted(p)) for p in graph.opposite(arms)) == [(0, 2), (1, 3)]
    assert graph.opposite([(0.0, 0)]) == []
    assert len(graph.opposite([(0.1 * k, k) for k in range(5)])) == 2


def test_snapping(spark):
    ends = [(1, 0, 0, 0, 0, 0.0), (1, 0, 1, 0, 0, None), (1, 1, 0, 100, 0, 90.0), (1, 2, 0, 200, 0, None), (1, 3, 0, 300, 0, 0.0)]
    terminals = spark.createDataFrame(ends, "drawing_id long, symbol_id int, idx int, x int, y int, direction_deg double")
    at = lambda *p: spark.createDataFrame([(1, n, x, y) for n, x, y in p], "drawing_id long, net_ord int, x int, y int")
    points = at((0, 25, 1), (1, 26, 0), (2, -5, 0), (0, 100, 10), (1, 100, -5), (0, 212, 0), (1, 212, 0), (3, 300, 0), (2, 301, 0))
    got = {(r.symbol_id, r.idx): r.net_ord for r in graph.snapped(terminals, points).collect()}
    # up to but not at one more than the reach; a cone ahead; ties to the first net; at the terminal in any direction
    assert got == {(0, 0): 0, (0, 1): 2, (1, 0): 0, (2, 0): 0, (3, 0): 3}


def test_connections_and_findings(spark):
    members = spark.createDataFrame([(1, 0, "B"), (1, 0, "A"), (1, 1, "A"), (1, 1, "C"), (1, 1, "B"), (1, 2, "D")], "drawing_id long, net_ord int, symbol_id string")
    got = {r.symbol_id: r.connections for r in graph.connections(members).collect()}
    assert got == {"A": ["B", "C"], "B": ["A", "C"], "C": ["A", "B"]}
    symbols = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.4), (1, "C", 0.9)], "drawing_id long, symbol_id string, confidence double")
    ends = spark.createDataFrame([(1, "A", 0, "N000"), (1, "A", 1, None), (1, "B", 0, None)], "drawing_id long, symbol_id string, idx int, net_id string")
    nets = spark.createDataFrame([(1, "N000"), (1, "N001")], "drawing_id long, net_id string")
    got = sorted((r.kind, r.object_id, r.idx) for r in graph.findings(symbols, ends, nets).fillna(-1, "idx").collect())
    assert got == [("isolated", "B", -1), ("low_confidence", "B", -1), ("single_terminal", "N000", -1), ("single_terminal", "N001", -1), ("unattached", "A", 1), ("unattached", "B", 0)]


def test_runs(spark):
    rnd = random.Random(5)
    rows = [(k % 3, rnd.randrange(40)) for k in range(60)] + [(9, 4), (8, 1), (8, 2), (8, 4), (8, 5), (7, None)]
    df = spark.createDataFrame(rows, "k int, at int")
    want = []
    for k in {r[0] for r in rows}:
        values = sorted({a for j, a in rows if j == k and a is not None})
        for a in values:
            if a - 1 not in values:
                b = a
                while b + 1 in values:
                    b += 1
                want.append((k, a, b, b - a + 1))
    got = runs.runs(df, ["k"], "at")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    best = {r.k: (r.start, r.length) for r in runs.longest(got, ["k"]).collect()}
    assert best[8] == (1, 2) and best == {k: min(((a, n) for j, a, _, n in want if j == k), key=lambda x: (-x[1], x[0])) for k in best}
    assert runs.runs(df, ["k"], "at", 3).where("length < 3").isEmpty()


def test_specialist_rules(spark):
    rows = [(1, False, True), (2, False, False), (2, False, True), (3, True, True), (4, True, False), (None, None, None)]
    df = spark.createDataFrame(rows, "n int, c boolean, p boolean")
    got = [r.e and (r.e["class"], r.e.confidence) for r in df.select(specialists.battery_or_capacitor(F.col("n"), F.col("c"), F.col("p")).alias("e")).collect()]
    assert got == [None, ("Capacitor", 0.6), ("Battery", 0.55), ("Capacitor_Polarized", 0.7), ("Battery", 0.85), None]
    rows = spark.createDataFrame([(True, True), (False, True), (False, False)], "c boolean, r boolean")
    got = [r.e and [x["class"] for x in r.e] for r in rows.select(specialists.transistor_or_potentiometer(F.col("c"), F.col("r")).alias("e")).collect()]
    assert got == [["BJT_NPN", "BJT_PNP"], ["Potentiometer"], None]


def test_partitions_and_row_order_don_t_matter(spark):
    a, b = random_boxes(3, 80, side=300), random_boxes(3, 80, side=300)
    gold = made(spark, a).withColumn("type", F.lit("R"))
    runs_ = []
    for n in (1, 7):
        rows = list(b)
        random.Random(n).shuffle(rows)
        pred = made(spark, rows).withColumn("type", F.lit("R")).repartition(n)
        runs_.append(sorted((r.drawing_id, r.gi, r.pi) for r in evaluate.matches(gold.repartition(n), pred).collect()))
    assert runs_[0] == runs_[1]


def merge_by_restarting(rows, least):
    """The definition: the first overlapping pair in order is joined in the earlier place, then all over again."""
    rows = list(rows)
    while True:
        for i, j in ((i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))):
            a, b = rows[i], rows[j]
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if w > 0 and h > 0 and w * h / min((r[2] - r[0]) * (r[3] - r[1]) for r in (a, b)) >= least:
                rows[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                del rows[j]
                break
        else:
            return rows


@pytest.mark.parametrize("seed", range(6))
def test_merge_equals_restarting(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        rows = []
        for _ in range(rnd.choice([0, 1, 5, 25])):
            x, y = rnd.randrange(60), rnd.randrange(60)
            rows.append((x, y, x + rnd.randrange(1, 25), y + rnd.randrange(0, 25)))
        assert merge(rows) == merge_by_restarting(rows, 0.5)


def test_nets_are_numbered_over_all_components(spark):
    """A lone pixel and a blot without arms take a number, so ids have gaps; junctions come after pixels."""
    picture = ["#....####", ".........", "..##.....", "..##.....", ".........", "####.....", ".........", "........#"]
    found = graph.nets(graph.rewired(*drawn(spark, picture)))
    got = {r.net_id: r.n for r in found.groupBy("net_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"N001": 4, "N002": 4}
    assert graph.nets(graph.rewired(*drawn(spark, ["##", "##"]))).collect() == []
    empty = drawn(spark, ["#"])[0].where("y < 0")
    assert graph.nets(graph.rewired(empty, empty)).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_rewiring_against_sets(spark, seed):
    """The same rules over sets and dictionaries, on random strokes."""
    rnd = random.Random(seed)
    pixels = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(rnd.choice([5, 30, 60]))}
    for _ in range(3):
        y, x, n = rnd.randrange(14), rnd.randrange(14), rnd.randrange(4, 10)
        pixels |= {(y, x + k) for k in range(n)} | {(y - 3 + k, x + 3) for k in range(n)}
    dots = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(2)}
    around = lambda p: [q for q in ((p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b) if q in pixels]
    branch = {p for p in pixels if len(around(p)) >= 3}
    links = {(0, *p): set() for p in pixels - branch}

    def join(a, b):
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)

    for p in pixels - branch:
        for q in around(p):
            if q not in branch:
                join((0, *p), (0, *q))
    left = set(branch)
    while left:
        region, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            region.add(p)
            more = [q for q in around(p) if q in left]
            left -= set(more)
            todo += more
        arms = sorted((*p, *q) for p in region for q in around(p) if q not in region)
        cy, cx = (int(sum(p[k] for p in region) / len(region)) for k in (0, 1))
        if any(abs(cy - y) <= 4 and abs(cx - x) <= 4 for y, x in dots) or len(arms) < 4:
            links.setdefault((1, cy, cx), set())
            for a in arms:
                join((1, cy, cx), (0, *a[2:]))
        else:
            for i, j in graph.opposite([(math.atan2(a[2] - a[0], a[3] - a[1]), k) for k, a in enumerate(arms)]):
                join((0, *arms[i][2:]), (0, *arms[j][2:]))
    parts, seen = [], set()
    for node in sorted(links):
        if node not in seen:
            part, todo = set(), [node]
            while todo:
                n = todo.pop()
                if n not in part:
                    part.add(n)
                    todo += links[n]
            seen |= part
            parts.append(part)
    want = {(k, *n) for k, part in enumerate(parts) if len(part) > 1 for n in part}
    one = lambda rows: spark.createDataFrame([(7, *p) for p in rows], "drawing_id long, y int, x int")
    found = graph.nets(graph.rewired(one(pixels).repartition(3), one(dots)))
    assert {(r.net_ord, r.node.kind, r.node.y, r.node.x) for r in found.collect()} == want


def test_nearest_leaves_odd_vectors_out(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [1.0], 1), (6, [0.0, 1.0], 2), (7, [1.0, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    found = evidence.nearest(df.select(F.col("vec_id").alias("query_id"), "v"), df, 2)
    assert {(r.query_id, r["rank"], r.vec_id) for r in found.collect()} == {(1, 1, 7), (1, 2, 2), (2, 1, 1), (2, 2, 7), (6, 1, 2), (6, 2, 1), (7, 1, 1), (7, 2, 2)}
    assert evidence.nearest(df.limit(0).select(F.col("vec_id").alias("query_id"), "v"), df).collect() == [] and evidence.nearest(df.select(F.col("vec_id").alias("query_id"), "v"), df.limit(0)).collect() == []


def test_scores_are_not_rounded_before_ranking(spark):
    """Sums in the order of sources decide, to the last place."""
    rows = [(1, "a", 0, 0, "X", 0.1, 1.0), (1, "b", 1, 0, "X", 0.2, 1.0), (1, "c", 2, 0, "X", 0.3, 1.0), (1, "b", 1, 1, "Y", 0.6, 1.0)]
    df = spark.createDataFrame(rows, "k int, source string, source_ord int, class_ord int, class string, score double, confidence double").repartition(4)
    assert [(r["class"], r.total) for r in evidence.fused(df, {}, ["k"]).orderBy("rank").collect()] == [("X", 0.1 + 0.2 + 0.3), ("Y", 0.6)]


def test_far_boxes_have_few_cells(spark):
    a = made(spark, [(1, 0, -(10**9), 0, 10**9, 10), (1, 1, 10**9 - 5, 0, 10**9, 10), (1, 2, 0, 0, 5, 5)])
    assert sorted((r.a_idx, r.b_idx) for r in boxes.overlapping(a).collect()) == [(0, 1), (0, 2)]
