"""The queries over the driver's tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions import geometry as G
from wireloom.functions import text as T
from wireloom.config import Config
from wireloom.operators import boxes, evidence, graph, matching, raster, runs, specialists, text
from wireloom.plans import bind, evaluate, interpret
from wireloom.shipping import shipped
from wireloom.sinks import netlists, sheets
from wireloom.sources import domains, kicad, library, readings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
D = "drawing_id"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = shipped(f)
    return f


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = bind.lines(spark, sf_dir)
    return bind.gold(lines), bind.pred(lines)


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gold, pred = _both(spark, sf_dir)
    return gold, pred, evaluate.matches(gold, pred)


@query
def iou_theta_join(spark, sf_dir):
    met = boxes.iou_pairs(*_both(spark, sf_dir))
    return met.select(D, F.col("a_idx").alias("gi"), F.col("b_idx").alias("pi"), "iou")


@query
def eval_detection(spark, sf_dir):
    return evaluate.detection(*_matched(spark, sf_dir))


@query
def confusion_pairs(spark, sf_dir):
    return evaluate.confusions(_matched(spark, sf_dir)[2])


@query
def eval_connectivity(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    found = evaluate.matches(bind.gold(lines), bind.pred(lines))
    return evaluate.connectivity(bind.co_members(bind.members(lines)), bind.co_members(bind.predicted_members(lines)), found)


@query
def micro_totals_rollup(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    said = docs.join(labels, "doc_id").select("lang", "source", (F.col("n_chars") >= 500).alias("p"), (F.col("quality") == 1).alias("g"))
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    p, g = F.col("p"), F.col("g")
    sums = said.rollup("lang", "source").agg(n(p & g, "tp"), n(p & ~g, "fp"), n(~p & g, "fn"), F.grouping_id().cast("int").alias("level"))
    a, b, c = G.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("lang", "source", "level", "tp", "fp", "fn", a.alias("precision"), b.alias("recall"), c.alias("f1"))


@query
def box_overlap_pairs(spark, sf_dir):
    met = boxes.overlapping(bind.gold(bind.lines(spark, sf_dir)))
    return met.select(D, F.col("a_idx").alias("i"), F.col("b_idx").alias("j"), "overlap", "x0", "y0", "x1", "y1")


@query
def box_merge_fixpoint(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    seen = (
        F.when(F.expr("l_partkey % 4 = 0"), "ambiguous").otherwise("symbol").alias("kind"), F.when(F.expr("l_suppkey % 3 > 0"), F.col("l_returnflag")).alias("class"),
        F.when(F.expr("l_suppkey % 5 > 0"), F.col("l_discount") * 10).alias("confidence"), F.when(F.expr("l_linenumber % 2 = 0"), "synthetic_yolo").otherwise("real_detector").alias("source"),
    )
    return matching.merged(bind.gold(lines, *seen).drop("type"), 0.5)


def _near(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    return boxes.near_tokens(bind.gold(lines), bind.tokens(lines))


@query
def box_gap_range_join(spark, sf_dir):
    return _near(spark, sf_dir).select(D, F.col("a_idx").alias("idx"), F.col("b_ord").alias("ord"), "distance")


@query
def nearest_tokens_text(spark, sf_dir):
    return text.nearest_text(_near(spark, sf_dir)).select(D, F.col("a_idx").alias("idx"), "text")


@query
def first_value_token(spark, sf_dir):
    return text.first_value(_near(spark, sf_dir)).select(D, F.col("a_idx").alias("idx"), "value")


@query
def greedy_ids(spark, sf_dir):
    return text.ids(_near(spark, sf_dir)).select(D, F.col("a_idx").alias("idx"), "id")


@query
def ocr_normalize(spark, sf_dir):
    return bind.hints(bind.lines(spark, sf_dir)).select(D, "idx", "text", T.normalized(F.col("text")).alias("normalized"))


@query
def designator_prefix_join(spark, sf_dir):
    pack = domains.load("electronic")
    return text.designators(bind.tokens(bind.lines(spark, sf_dir)), domains.prefix_table(spark, pack), [D, "ord"])


@query
def part_family_join(spark, sf_dir):
    return text.families(bind.hints(bind.lines(spark, sf_dir)), domains.load("electronic").families).select(D, "idx", "family")


@query
def text_prior_evidence(spark, sf_dir):
    pack = domains.load("electronic")
    found = text.text_evidence(bind.hints(bind.lines(spark, sf_dir)), domains.prefix_table(spark, pack), pack.families, [D, "idx"])
    return found.select(D, "idx", "level", "class", "score", F.col("confidence").cast("double").alias("confidence"))


@query
def router_scores(spark, sf_dir):
    packs = {n: (list(p.prefixes), p.keywords) for n, p in domains.packs().items()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return text.router_scores(docs, packs).select("doc_id", "electronic", "pid", "domain")


def _nearest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    rows = rows.where("vec_id is not null and v is not null")
    return evidence.nearest(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v"), rows)


@query
def knn_neighbours(spark, sf_dir):
    return _nearest(spark, sf_dir).select("query_id", "rank", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query
def knn_topk_classes(spark, sf_dir):
    return evidence.best_classes(_nearest(spark, sf_dir), 0.62).select("query_id", "rank", "label", "similarity", "above")


def _ranked(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    return lines.select(D, "idx"), evidence.fused(bind.evidence(lines), domains.load("electronic").weights, [D, "idx"])


@query
def fuse_evidence(spark, sf_dir):
    candidates, ranked = _ranked(spark, sf_dir)
    out = evidence.winners(candidates, ranked, [D, "idx"])
    return out.select(D, "idx", "class", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "top")


@query
def ambiguous_group_routing(spark, sf_dir):
    return evidence.routed(_ranked(spark, sf_dir)[1], [("zero", ["Z", "O"]), ("flags", ["A", "N", "R"])], [D, "idx"])


@query
def template_instantiate(spark, sf_dir):
    """Three terminals of a template, turned and mirrored in eight ways, on each golden box."""
    points = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("tx"), F.lit(y).alias("ty"), F.lit(a).alias("bx"), F.lit(b).alias("by")) for n, x, y, a, b in (("B", 0, 50, 25, 50), ("C", 75, 0, 75, 20), ("E", 75, 99, 75, 99))])
    g = bind.gold(bind.lines(spark, sf_dir))
    size = F.lit(100)
    each = g.withColumn("turn", F.expr("cast(90 * (x0 % 4) as int)")).withColumn("mirrored", F.expr("y0 % 2 = 1")).select("*", F.posexplode(points).alias("k", "p"))
    flip = lambda c: F.when(F.col("mirrored"), size - 1 - c).otherwise(c)
    tip = G.turned(flip(F.col("p.tx")), F.col("p.ty"), size, size, F.col("turn"))
    body = G.turned(flip(F.col("p.bx")), F.col("p.by"), size, size, F.col("turn"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    on = [G.placed(c / 100.0, start, s) for c, start, s in ((tip[0], F.col("x0"), w), (tip[1], F.col("y0"), h), (body[0], F.col("x0"), w), (body[1], F.col("y0"), h))]
    out = each.select(D, "idx", "k", F.col("p.name").alias("name"), *[c.alias(n) for c, n in zip(on, ("x", "y", "bx", "by"))])
    return out.select(D, "idx", "k", "name", "x", "y", F.round(G.direction(F.col("x") - F.col("bx"), F.col("y") - F.col("by")), 6).alias("direction_deg"))


def _attached(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    ends, points = bind.terminals(lines), bind.wire_points(lines)
    return lines, ends, points, graph.snapped(ends, points)


@query
def directional_snap(spark, sf_dir):
    return _attached(spark, sf_dir)[3].select(D, "symbol_id", "idx", "net_ord", "distance")


@query
def validate_findings(spark, sf_dir):
    lines, ends, points, at = _attached(spark, sf_dir)
    name = F.format_string("N%03d", F.col("net_ord"))
    ends = ends.join(at, [D, "symbol_id", "idx"], "left").select(D, F.format_string("SYM_%03d", F.col("symbol_id")).alias("symbol_id"), "idx", F.when(F.col("net_ord").isNotNull(), name).alias("net_id"))
    symbols = lines.select(D, F.format_string("SYM_%03d", F.col("idx")).alias("symbol_id"), (F.col("l_discount") * 10).alias("confidence"))
    return graph.findings(symbols, ends, points.select(D, name.alias("net_id")).distinct())


@query
def net_connections(spark, sf_dir):
    m = bind.members(bind.lines(spark, sf_dir)).withColumn("symbol_id", F.format_string("SYM_%03d", F.col("idx")))
    return graph.connections(m).select(D, "symbol_id", F.array_join("connections", ",").alias("connections"))


@query
def connected_components(spark, sf_dir):
    """Orders chained to the next order of the same customer, and some customers' first orders to the last of another."""
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    chain = orders.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(line).alias("b")).where("b is not null")
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    other = ends.select((F.col("o_custkey") + 3).alias("o_custkey"), "b")
    linked = ends.drop("b").where("o_custkey % 16 < 11").join(other, "o_custkey").select("a", "b")
    return graph.roots(chain.union(linked).select(F.lit(0).alias(D), "a", "b"), [D]).select("node", "root")


@query
def crossing_rewire(spark, sf_dir):
    pixels, dots = bind.crossings(spark, sf_dir)
    found = graph.nets(graph.rewired(pixels, dots))
    return found.groupBy(D, "net_ord").agg(F.count("*").alias("nodes"), F.sum(F.col("node.kind")).alias("junctions"))


@query
def degree_neighbors(spark, sf_dir):
    return graph.degrees(bind.crossings(spark, sf_dir)[0]).select(D, "y", "x", "degree")


def _hours(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("hour"))


@query
def runs_islands(spark, sf_dir):
    return runs.runs(_hours(spark, sf_dir), ["user_id"], "hour", 2)


@query
def longest_run(spark, sf_dir):
    return runs.longest(runs.runs(_hours(spark, sf_dir), ["user_id"], "hour"), ["user_id"])


@query
def density_window(spark, sf_dir):
    cells = _hours(spark, sf_dir).groupBy((F.col("user_id") % 24).alias("x"), (F.col("hour") % 24).alias("y")).agg(F.count("*").alias("n"))
    return runs.windowed_sums(cells, "x", "y", "n", 2)


@query
def set_ops(spark, sf_dir):
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    a, b = customer.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k"))
    kinds = (("both", a.intersect(b)), ("first", a.subtract(b)), ("second", b.subtract(a)), ("all", a.unionByName(b)))
    rows = None
    for name, df in kinds:
        df = df.select(F.lit(name).alias("kind"), "k")
        rows = df if rows is None else rows.unionByName(df)
    return rows.groupBy("kind", "k").agg(F.count("*").alias("n"))


@query
def json_sidecar(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query
def netlist_json(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    linked = graph.connections(bind.members(lines).withColumn("symbol_id", F.format_string("SYM_%03d", F.col("idx"))))
    symbols = bind.gold(lines).withColumn("id", F.format_string("SYM_%03d", F.col("idx"))).join(linked.withColumnRenamed("symbol_id", "id"), [D, "id"], "left")
    return netlists.netlists(symbols)


@query
def graph_export(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    net = F.format_string("N%03d", F.col("net_ord"))
    symbols = bind.gold(lines).select(D, F.format_string("SYM_%03d", F.col("idx")).alias("node"), F.lit("symbol").alias("kind"), F.col("type").alias("label"))
    members = bind.members(lines)
    nodes = symbols.unionByName(members.select(D, net.alias("node"), F.lit("net").alias("kind"), F.lit(None).cast("string").alias("label")).distinct())
    return netlists.graphml(nodes, members.select(D, F.format_string("SYM_%03d", F.col("idx")).alias("a"), net.alias("b")))


@query
def signature_hash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", F.col("n_chars").cast("string"), "text"), 256).alias("signature"))


@query
def report_export(spark, sf_dir):
    report = evaluate.detection(*_matched(spark, sf_dir))
    return report.select("scope", F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("tp", "fp", "fn", "correct")]).alias("line"))


@query
def ocr_tokens(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    raw = lines.select(
        D, F.col("idx").alias("ord"), F.expr("case when l_partkey % 7 = 0 then '  ' else concat(' R', l_linenumber, ' ') end").alias("text"),
        F.expr("case when l_suppkey % 9 = 0 then 'n/a' when l_suppkey % 9 = 1 then '-1' else cast(l_partkey % 101 as string) end").alias("conf"),
        F.expr("cast(l_partkey % 200 as int)").alias("left"), F.expr("cast(l_suppkey % 150 as int)").alias("top"), F.expr("cast(l_quantity as int) + 1").alias("width"),
        F.expr("l_linenumber + 4").alias("height"), F.expr("cast(90 * (l_partkey % 4) as int)").alias("orientation"), F.lit(300).alias("page_width"), F.lit(240).alias("page_height"),
    )
    return readings.tokens(raw)


@query
def detection_boxes(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    raw = lines.select(
        D, "idx", F.expr("(l_partkey % 150) - 20.25D").alias("x"), F.expr("(l_suppkey % 120) - 20.5D").alias("y"), F.col("l_quantity").alias("width"), F.expr("cast(l_linenumber * 5 as double)").alias("height"),
        F.expr("l_discount * 10").alias("confidence"), F.lit(100).alias("page_width"), F.lit(80).alias("page_height"),
    )
    return readings.detections(raw).select(D, "idx", "x0", "y0", "x1", "y1")


@query
def response_keys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = docs.select("doc_id", readings.key(F.col("text"), "model", "conf=0.35").alias("key"))
    return asked.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query
def unmatched_symbols(spark, sf_dir):
    gold, pred, found = _matched(spark, sf_dir)
    left = gold.withColumnRenamed("idx", "gi").join(found, [D, "gi"], "left_anti").select(D, F.lit("golden").alias("side"), F.col("gi").alias("idx"), "type")
    right = pred.withColumnRenamed("idx", "pi").join(found, [D, "pi"], "left_anti").select(D, F.lit("predicted").alias("side"), F.col("pi").alias("idx"), "type")
    return left.unionByName(right)


@query
def specialist_rules(spark, sf_dir):
    facts = bind.lines(spark, sf_dir).select(
        D, "idx", F.expr("if(l_partkey % 9 = 0, null, cast(l_partkey % 6 as int))").alias("plates"), F.expr("if(l_partkey % 9 = 0, null, l_suppkey % 3 = 0)").alias("curved"),
        F.expr("if(l_partkey % 9 = 0, null, l_linenumber % 2 = 0)").alias("plus"), F.expr("l_suppkey % 4 = 0").alias("circle"), F.expr("l_partkey % 2 = 0").alias("rectangle"),
    )
    said = facts.select(D, "idx", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), rule().alias("e")) for n, rule in specialists.SAYS.items()])).alias("s"))
    return said.select(D, "idx", F.col("s.name").alias("name"), F.explode("s.e").alias("e")).select(D, "idx", "name", "e.class", "e.score", "e.confidence")


@query
def arc_circles(spark, sf_dir):
    p = bind.gold(bind.lines(spark, sf_dir))
    d = lambda c: F.col(c).cast("double")
    x, y, r = G.circle_through((d("x0"), d("y0")), (d("x1"), d("y1")), (d("x1"), d("y0") + F.expr("idx % 3")))
    return p.select(D, "idx", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(r, 6).alias("radius"))


def _primitives(spark, sf_dir):
    """A library symbol per order: its lines are primitives in turn."""
    p = lambda x, y: f"named_struct('x', cast({x} as double), 'y', cast({y} as double))"
    a, b = p("l_partkey % 13", "l_suppkey % 11"), p("l_partkey % 7 - 9", "l_suppkey % 5 - 4")
    kind = "CASE l_partkey % 4 WHEN 0 THEN 'polyline' WHEN 1 THEN 'circle' WHEN 2 THEN 'rectangle' ELSE 'pin' END"
    points = f"CASE WHEN l_partkey % 2 = 1 THEN array({a}) ELSE array({a}, {b}) END"
    rest = ("cast(l_suppkey % 4 + 0.5 as double) AS radius", "cast(90 * (l_suppkey % 4) as double) AS angle", "cast(l_linenumber * 1.27 as double) AS length", "cast(idx as string) AS number")
    return bind.lines(spark, sf_dir).selectExpr("drawing_id AS symbol", "idx AS ord", f"{kind} AS kind", f"{points} AS points", *rest)


@query
def symbol_bounds(spark, sf_dir):
    found = kicad.bounds(_primitives(spark, sf_dir), ["symbol"])
    return found.select("symbol", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query
def symbol_terminals(spark, sf_dir):
    return kicad.terminals(_primitives(spark, sf_dir), ["symbol"]).select("symbol", "ord", "number", "x", "y")


@query
def library_templates(spark, sf_dir):
    """Parts are reference pictures with two terminals each; all eight variants."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand AS class", "p_partkey AS name", "cast(20 + p_size as int) AS width", "cast(30 + p_partkey % 17 as int) AS height")
    ends = parts.select("class", "name", F.explode(F.expr("""array(
        named_struct('idx', 0, 'terminal', 'A', 'x', 0, 'y', cast(height div 2 as int), 'body_x', 5, 'body_y', cast(height div 2 as int)),
        named_struct('idx', 1, 'terminal', 'B', 'x', width - 1, 'y', cast(name % 20 as int), 'body_x', width - 6, 'body_y', 3))""")).alias("e")).select("class", "name", "e.*")
    found = library.templates(ends, parts)
    return found.select("name", "turn", "mirrored", "idx", "terminal", *[F.round(c, 9).alias(c) for c in ("tx", "ty", "bx", "by")])


@query
def probe_topk(spark, sf_dir):
    """A linear probe of four classes whose weights follow from their places."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    weights = np.array([[((k + 1) * (j + 3) % 11) - 5 for j in range(64)] for k in range(4)], dtype=float)
    return evidence.probe(rows, weights, np.array([0.1, 0.2, 0.3, 0.4]), list("abcd")).select("query_id", "rank", "class", F.round("probability", 6).alias("probability"))


@query
def template_choice(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    won = lines.select(D, "idx", F.col("l_returnflag").alias("class"))
    near = lines.where("l_partkey % 3 = 0").select(D, "idx", F.expr("if(l_partkey % 2 = 0, l_returnflag, 'X')").alias("class"), F.expr("cast(l_suppkey % 16 as int)").alias("entry"))
    rows = [(c, 8 * n + k, 90 * ((k + n) % 4), k % 2 == 1) for n, c in enumerate(("A", "R")) for k in range(8)]
    return evidence.template_of(won, near, spark.createDataFrame(rows, "class string, entry int, turn int, mirrored boolean"), [D, "idx"]).select(D, "idx", "class", "entry")


@query
def node_link_json(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    net = F.format_string("N%03d", F.col("net_ord"))
    symbols = bind.gold(lines).select(D, F.format_string("SYM_%03d", F.col("idx")).alias("node"), F.lit("symbol").alias("kind"), F.col("type").alias("label"))
    members = bind.members(lines)
    nodes = symbols.unionByName(members.select(D, net.alias("node"), F.lit("net").alias("kind"), F.lit("").alias("label")).distinct())
    return netlists.node_link(nodes, members.select(D, F.format_string("SYM_%03d", F.col("idx")).alias("a"), net.alias("b")))


@query
def type_palette(spark, sf_dir):
    named = bind.gold(bind.lines(spark, sf_dir), F.expr("if(l_partkey % 10 = 0, 'Unknown', concat(l_returnflag, l_linestatus, l_linenumber))").alias("kind"))
    return sheets.coloured(named.drop("type").withColumnRenamed("kind", "type")).select(D, "idx", "type", "colour")


@query
def component_sizes(spark, sf_dir):
    lines = bind.lines(spark, sf_dir)
    symbols = lines.select(D, F.col("idx").alias("id"))
    edges = lines.where("l_partkey % 3 > 0").select(D, F.col("idx").alias("a"), F.expr("cast(l_suppkey % 7 as int)").alias("b"))
    edges = edges.join(symbols.withColumnRenamed("id", "b"), [D, "b"], "left_semi")
    return sheets.components(symbols, edges).select(D, "id", "part", "size")


#: Pictures of the queries: a gray value for each place of a customer's page, 24 by 20.
WIDE, HIGH = 24, 20


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS drawing_id")


def _values(key: int) -> np.ndarray:
    y, x = np.mgrid[:HIGH, :WIDE]
    return ((x * x + 3 * y * (key % 7 + 1) + (x // 6) * (y // 5) * 29 + key * 11) % 256).astype(np.uint8)


def _each(spark, sf_dir, work: Callable, schema: str) -> DataFrame:
    """Rows that work(key, picture) gives for each page; its column names go with the schema."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *row) for k in frame["drawing_id"] for row in work(k, _values(k))]
            yield pd.DataFrame(rows, columns=["drawing_id", *(c.split()[0] for c in schema.split(", "))])

    return _pages(spark, sf_dir).mapInPandas(make, f"drawing_id long, {schema}")


@query
def otsu_levels(spark, sf_dir):
    return _each(spark, sf_dir, lambda k, p: [(raster.otsu(p), int((p <= raster.otsu(p)).sum()))], "level int, dark long")


@query
def morphology_pixels(spark, sf_dir):
    """Ink of a page that a 3 by 2 opening keeps, that a 3 by 3 erosion keeps, and that a 2 by 2 dilation adds."""

    def work(key, picture):
        mask = picture < 128
        kinds = {"opened": raster.opened(mask, raster.box(2, 3)), "eroded": raster.eroded(mask, raster.box(3, 3)), "added": raster.dilated(mask, raster.box(2, 2)) & ~mask}
        return [(kind, int(y), int(x)) for kind, m in kinds.items() for y, x in zip(*np.nonzero(m))]

    return _each(spark, sf_dir, work, "kind string, y int, x int")


@query
def ink_components(spark, sf_dir):
    """Box and area of each component of a page's ink, 8-connected, specks under three pixels left out."""
    return _each(spark, sf_dir, lambda k, p: raster.stats(raster.labels(raster.without_speckles(p < 70, 3))), "x0 int, y0 int, x1 int, y1 int, area int")


@query
def wire_attachments(spark, sf_dir):
    """Where a page's ink reaches a box in its middle."""
    return _each(spark, sf_dir, lambda k, p: raster.attachments(p < 90, 7, 6, 16, 13, 4, 2), "x int, y int, direction_deg double")


@query
def interpreted_pages(spark, sf_dir):
    """A supplier's page: two blocks and a wire between them, whole or with a gap; from pixels to JSON."""

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k in frame["k"]:
                page = np.full((60, 140, 1), 255, np.uint8)
                a, b = 10 + k % 9, 90 + k % 11
                page[20:40, a : a + 20] = 0
                page[20:36, b : b + 26] = 0
                page[28:30, a + 20 : b] = 0
                if k % 3 == 0:
                    page[28:30, 55:70] = 255
                out.append((str(k), 60, 140, 1, page.tobytes()))
            yield pd.DataFrame(out, columns=["drawing_id", "height", "width", "channels", "data"])

    def blocks(picture: np.ndarray) -> list[dict]:
        solid = raster.stats(raster.labels(raster.opened(picture < 128, raster.box(10, 10))))
        return [{"x0": x0, "y0": y0, "x1": x1, "y1": y1, "kind": "symbol", "class": "Tall" if y1 - y0 > 18 else "Wide", "confidence": 0.9, "source": "synthetic_yolo"} for x0, y0, x1, y1, _ in sorted(solid)]

    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k")
    images = keys.mapInPandas(drawn, "drawing_id string, height int, width int, channels int, data binary")
    keys = images.select(D, F.col(D).cast("long").alias("k"))
    tokens = keys.where("k % 2 = 0").select(D, F.lit(0).alias("ord"), F.concat(F.lit("R"), F.expr("k % 900"), F.lit(" 10K")).alias("text"), F.lit(12).alias("x0"), F.lit(5).alias("y0"), F.lit(28).alias("x1"), F.lit(15).alias("y1"), F.lit(0.9).alias("confidence"), F.lit(0).alias("orientation"))
    found = interpret.interpret(spark, images, Config(domain="electronic"), interpret.Given(tokens=tokens, detect=blocks))
    return found["json"]
