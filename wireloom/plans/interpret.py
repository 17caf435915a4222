"""The whole way from pictures to a netlist, as one plan: detections, evidence, routing, a second fusion, templates, text, nets, checks, JSON.

Detectors, readers and embedding models come in as functions or tables.  Stages that later ones read more than once are
written to the shared folder, and their seconds are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.config import Config
from wireloom.functions import geometry as G
from wireloom.operators import evidence, graph, matching, specialists, text
from wireloom.operators.boxes import near_tokens
from wireloom.operators.lineage import kept
from wireloom.plans import pictures
from wireloom.sinks import netlists
from wireloom.sources import domains

D = "drawing_id"
BY = [D, "idx"]
TOKENS = "drawing_id string, ord int, text string, x0 int, y0 int, x1 int, y1 int, confidence double, orientation int"
EVIDENCE = "drawing_id string, idx int, source string, source_ord int, class_ord int, class string, score double, confidence double"
UNKNOWN = "Unknown"


@dataclass
class Given:
    """What a run is given besides pictures; all of it is optional."""

    #: Readings as sources.readings.tokens gives them, or a reader, see pictures.read.
    tokens: DataFrame | None = None
    reader: Callable | None = None
    #: Functions of a gray picture to boxes, see pictures.boxes; the second one's boxes are merged in.
    detect: Callable | None = None
    second: Callable | None = None
    #: Reference entries (class, entry, turn, mirrored, v) and their terminals (entry, k, name, tx, ty, bx, by as fractions), and the model that made v.
    library: DataFrame | None = None
    terminals: DataFrame | None = None
    embed: Callable | None = None
    #: A linear probe: weights, bias, classes.
    probe: tuple | None = None
    #: A folder of domain packs besides the package's.
    packs: str | None = None
    #: Further specialists by name, see specialists.opinions.
    says: dict = field(default_factory=dict)


def interpret(spark: SparkSession, images: DataFrame, c: Config = Config(), given: Given | None = None) -> dict[str, DataFrame | dict]:
    """symbols, terminals, nets, connections, findings, json (drawing_id, json), graph (drawing_id, xml), routes, and timings (seconds by stage)."""
    given = given or Given()
    timings: dict[str, float] = {}
    began = time.perf_counter()

    def done(stage: str, df: DataFrame) -> DataFrame:
        nonlocal began
        df = kept(df)
        timings[stage] = round(time.perf_counter() - began, 4)
        began = time.perf_counter()
        return df

    tokens = given.tokens
    if tokens is None:
        tokens = done("read", pictures.read(images, given.reader, c)) if given.reader else spark.createDataFrame([], TOKENS)
    packs = domains.packs(given.packs)
    routes = done("route", routed(images, tokens, packs, c))
    candidates = done("localize", located(images, tokens, c, given))
    near = near_tokens(candidates.select(*BY, "x0", "y0", "x1", "y1"), tokens.select(D, "ord", "text", "x0", "y0", "x1", "y1"), c.token_distance)
    near = done("text_detect", near.select(D, "a_idx", "distance", "b_ord", "b_text"))
    hints = text.nearest_text(near).withColumnRenamed("a_idx", "idx")
    ranked, matched = classified(spark, images, candidates, hints, routes, packs, c, given)
    classes = done("classify", evidence.winners(candidates.select(*BY, "x0", "y0", "x1", "y1"), ranked, BY, UNKNOWN).drop("top"))
    symbols, ends = templated(classes, matched, given)
    ids, values = (df.withColumnRenamed("a_idx", "idx") for df in (text.ids(near), text.first_value(near)))
    named = symbols.join(ids.withColumnRenamed("id", "read"), BY, "left").join(values, BY, "left").join(hints.withColumnRenamed("text", "ocr_text_raw"), BY, "left")
    source = F.when(F.col("read").isNotNull(), "ocr").otherwise("classification")
    symbols = done("text_associate", named.withColumn("id", F.coalesce("read", F.format_string("SYM_%03d", F.col("idx")))).withColumn("label_source", source).drop("read"))
    ends = pictures.refined(images, symbols, ends, c)
    nodes = done("wires", pictures.nets(images, symbols, c))
    points = nodes.select(D, "net_ord", F.col("node.x").alias("x"), F.col("node.y").alias("y"))
    at = graph.snapped(ends, points, c.snap_radius, c.snap_reach, c.snap_cone_degrees)
    called = symbols.select(D, F.col("idx").alias("symbol_id"), "id")
    attached = ends.join(at.drop("distance"), [D, "symbol_id", "idx"], "left").join(called, [D, "symbol_id"])
    net_id = F.when(F.col("net_ord").isNotNull(), F.format_string("N%03d", F.col("net_ord")))
    terminals = done("terminals", attached.withColumn("net_id", net_id))
    listed = terminals.select(D, F.col("id").alias("symbol_id"), "idx", "net_ord", "net_id")
    nets = nodes.groupBy(D, "net_ord", "net_id").agg(F.count("*").alias("nodes"), F.sum(F.col("node.kind")).alias("junctions"))
    findings = graph.findings(symbols.select(D, F.col("id").alias("symbol_id"), F.col("score").alias("confidence")), listed, nets.select(D, "net_id"), c.least_confidence)
    connections = graph.connections(listed.where("net_id is not null"))
    rows = symbols.join(connections.withColumnRenamed("symbol_id", "id"), [D, "id"], "left").withColumn("type", F.col("class"))
    sheets = images.select(D).join(netlists.netlists(rows), D, "left").select(D, F.coalesce("json", F.lit('{"symbols":[]}')).alias("json"))
    kind = lambda df, node, name, label: df.select(D, F.col(node).alias("node"), F.lit(name).alias("kind"), label.alias("label"))
    both = kind(symbols, "id", "symbol", F.col("class")).unionByName(kind(nets, "net_id", "net", F.lit(None).cast("string")))
    xml = netlists.graphml(both, listed.where("net_id is not null").select(D, F.col("symbol_id").alias("a"), F.col("net_id").alias("b")).distinct())
    return {
        "symbols": symbols, "terminals": terminals, "nets": nets, "connections": connections, "findings": findings, "json": done("output", sheets), "graph": xml,
        "routes": routes, "timings": timings,
    }


def routed(images: DataFrame, tokens: DataFrame, packs: dict[str, domains.Pack], c: Config) -> DataFrame:
    """(drawing_id, domain): the settings' domain, or the one that a drawing's text speaks for."""
    if c.domain != "auto":
        if c.domain not in packs:
            raise ValueError(f"no domain {c.domain!r}; there are {', '.join(sorted(packs))}")
        return images.select(D, F.lit(c.domain).alias("domain"))
    said = tokens.groupBy(D).agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    pages = images.select(D).join(said, D, "left").withColumn("text", F.coalesce("text", F.lit("")))
    return text.router_scores(pages, {n: (list(p.prefixes), p.keywords) for n, p in packs.items()}).select(D, "domain")


def located(images: DataFrame, tokens: DataFrame, c: Config, given: Given) -> DataFrame:
    """Candidate boxes: the detector's, or proposals; the second detector's merged in."""
    found = pictures.boxes(images, c, given.detect if c.use_detector else None, tokens)
    if c.use_second_detector and given.second:
        found = kept(found)
        more = pictures.boxes(images, c, given.second).withColumn("idx", F.col("idx") + (1 << 20))
        found = matching.merged(found.unionByName(more), c.merge_overlap)
    return found


def classified(spark: SparkSession, images: DataFrame, candidates: DataFrame, hints: DataFrame, routes: DataFrame, packs: dict[str, domains.Pack], c: Config, given: Given) -> tuple[DataFrame, DataFrame]:
    """The fused ranking of each candidate's classes, and which library entries it matched (by..., class, entry)."""
    crops = kept(pictures.crops(images, candidates))
    votes = candidates.where("class is not null").select(*BY, F.lit("yolo").alias("source"), F.lit(0).alias("source_ord"), F.lit(0).alias("class_ord"), "class", F.lit(1.0).alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    matched = spark.createDataFrame([], "drawing_id string, idx int, class string, entry string")
    if given.embed:
        v = kept(pictures.vectors(crops, given.embed).withColumn("query_id", F.monotonically_increasing_id()))
        if given.library is not None:
            near = known(spark, v, given.library, c.similarity_floor)
            votes = votes.unionByName(near.where("above").select(*BY, F.lit("dinov2").alias("source"), F.lit(1).alias("source_ord"), (F.col("rank") - 1).alias("class_ord"), "class", F.col("similarity").alias("score"), F.lit(1.0).alias("confidence")))
            matched = near.select(*BY, "class", "entry")
        if given.probe:
            said = evidence.probe(v, *given.probe).join(v.select("query_id", *BY), "query_id")
            votes = votes.unionByName(said.select(*BY, F.lit("dinov2_probe").alias("source"), F.lit(2).alias("source_ord"), (F.col("rank") - 1).alias("class_ord"), "class", F.col("probability").alias("score"), F.lit(1.0).alias("confidence")))
    ranked = None
    for name, pack in packs.items():
        mine = routes.where(F.col("domain") == name).select(D)
        table = domains.prefix_table(spark, pack)
        read = text.text_evidence(hints.join(mine, D, "left_semi"), table, pack.families, BY).join(table.groupBy("class").agg(F.min("class_ord").alias("class_ord")), "class", "left")
        read = read.select(*BY, F.lit("text_prior").alias("source"), F.lit(3).alias("source_ord"), F.coalesce("class_ord", F.lit(0)).alias("class_ord"), "class", "score", F.col("confidence").cast("double").alias("confidence"))
        own = kept(votes.join(mine, D, "left_semi").unionByName(read))
        first = evidence.fused(own, pack.weights, BY)
        if pack.groups:
            # a close call goes to its specialist, whose word is fused with the others
            geometry = specialists.opinions(crops, evidence.routed(kept(first), pack.groups, BY), BY, says=given.says)
            first = evidence.fused(own.unionByName(geometry.select(own.columns)), pack.weights, BY)
        ranked = first if ranked is None else ranked.unionByName(first)
    return kept(ranked), matched


def known(spark: SparkSession, v: DataFrame, library: DataFrame, floor: float, most: int = 3) -> DataFrame:
    """(by..., rank, class, similarity, above, entry): the nearest classes of each crop, with the entry of the class that is nearest.

    A library holds the reference pictures' variants, some hundreds or thousands.
    """
    classes = [r[0] for r in library.select("class").distinct().orderBy("class").collect()]
    number = F.create_map(*[x for k, name in enumerate(classes) for x in (F.lit(name), F.lit(k))]) if classes else F.create_map().cast("map<string,int>")
    # below 0, so that no crop has an entry's number
    rows = kept(library.select("class", "entry", "v").sort("entry").withColumn("vec_id", F.monotonically_increasing_id() - (1 << 62)).withColumn("label", number[F.col("class")]))
    near = evidence.nearest(v.select("query_id", "v"), rows.select("vec_id", "v", "label"), 20)
    best = near.groupBy("query_id", "label").agg(F.min_by("vec_id", F.struct(-F.col("similarity"), "vec_id")).alias("vec_id"))
    top = evidence.best_classes(near, floor, most).join(best, ["query_id", "label"]).join(rows.select("vec_id", "class", "entry"), "vec_id")
    return top.join(v.select("query_id", *BY), "query_id").select(*BY, "rank", "class", "similarity", "above", "entry")


def templated(classes: DataFrame, matched: DataFrame, given: Given) -> tuple[DataFrame, DataFrame]:
    """Symbols with their library entry's turn, and their terminals where the entry has them."""
    if given.library is None:
        return classes.withColumn("rotation", F.lit(0)), classes.sparkSession.createDataFrame([], pictures.TERMINALS)
    entries = given.library.select("class", "entry", "turn", "mirrored")
    chosen = evidence.template_of(classes, matched, entries, BY).join(entries.select("entry", F.col("turn").alias("rotation")), "entry", "left")
    symbols = kept(chosen.withColumn("rotation", F.coalesce("rotation", F.lit(0))))
    if given.terminals is None:
        return symbols.drop("entry"), classes.sparkSession.createDataFrame([], pictures.TERMINALS)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    on = symbols.join(given.terminals, "entry")
    placed = on.select(*BY, "k", "name", *[G.placed(F.col(t), F.col(start), size).alias(n) for t, start, size, n in (("tx", "x0", w, "x"), ("ty", "y0", h, "y"), ("bx", "x0", w, "bx"), ("by", "y0", h, "by"))])
    way = G.direction(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    ends = placed.select(D, F.col("idx").alias("symbol_id"), F.col("k").cast("int").alias("idx"), F.expr("nullif(name, '')").alias("name"), "x", "y", F.lit("library").alias("source"), way.alias("direction_deg"))
    return symbols.drop("entry"), ends


def averages(size: int = 8) -> Callable[[list[np.ndarray]], np.ndarray]:
    """A model without weights: a picture's ink in size by size cells. For tests and libraries without a network."""

    def embed(squares: list[np.ndarray]) -> np.ndarray:
        out = []
        for s in squares:
            edges = np.linspace(0, len(s), size + 1).astype(int)
            cells = [255.0 - s[a : max(b, a + 1), c : max(d, c + 1)].mean() for a, b in zip(edges, edges[1:]) for c, d in zip(edges, edges[1:])]
            out.append(np.array(cells) + 1.0)
        return np.array(out)

    return embed
