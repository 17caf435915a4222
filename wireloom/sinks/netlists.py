"""Netlists as JSON, graphs as GraphML and node-link JSON, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


START = (
    '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
    '<key id="kind" for="node" attr.name="kind" attr.type="string"/><key id="label" for="node" attr.name="label" attr.type="string"/><graph edgedefault="undirected">'
)


def netlists(symbols: DataFrame) -> DataFrame:
    """(drawing_id, json): {"symbols": [{id, type, coordinates, connections}]} in idx order; symbols has idx, id, type, x0..y1, connections."""
    one = F.struct("idx", "id", "type", F.array("x0", "y0", "x1", "y1").alias("coordinates"), F.coalesce("connections", F.array().cast("array<string>")).alias("connections"))
    listed = F.transform(F.sort_array(F.collect_list(one)), lambda s: F.struct(s["id"].alias("id"), s["type"].alias("type"), s["coordinates"].alias("coordinates"), s["connections"].alias("connections")))
    return symbols.groupBy("drawing_id").agg(F.to_json(F.struct(listed.alias("symbols"))).alias("json"))


def _xml(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(drawing_id, xml) of the bipartite graph: nodes (drawing_id, node, kind, label; null is ''), edges (drawing_id, a, b)."""
    n = F.concat(F.lit('<node id="'), _xml(F.col("node")), F.lit('"><data key="kind">'), _xml(F.col("kind")), F.lit('</data><data key="label">'), _xml(F.col("label")), F.lit("</data></node>"))
    e = F.concat(F.lit('<edge source="'), _xml(F.col("a")), F.lit('" target="'), _xml(F.col("b")), F.lit('"/>'))
    rows = nodes.select("drawing_id", F.lit(0).alias("k"), n.alias("line")).union(edges.select("drawing_id", F.lit(1), e))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "")
    return rows.groupBy("drawing_id").agg(F.concat(F.lit(START), body, F.lit("</graph></graphml>")).alias("xml"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(drawing_id, json) of the same graph: {"directed": false, "nodes": [{id, kind, label}], "links": [{source, target}]}."""
    n = nodes.groupBy("drawing_id").agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("id"), "kind", "label"))).alias("nodes"))
    e = edges.groupBy("drawing_id").agg(F.sort_array(F.collect_list(F.struct(F.col("a").alias("source"), F.col("b").alias("target")))).alias("links"))
    both = n.join(e, "drawing_id", "left")
    links = F.coalesce("links", F.array().cast("array<struct<source:string,target:string>>"))
    return both.select("drawing_id", F.to_json(F.struct(F.lit(False).alias("directed"), "nodes", links.alias("links"))).alias("json"))


def write_each(rows: DataFrame, value: str, path: str) -> None:
    """One text per drawing, in folders drawing_id=...; a drawing's file is small, and no two share one."""
    rows.select("drawing_id", F.col(value).alias("value")).write.partitionBy("drawing_id").mode("overwrite").text(path)
