"""Drawings of results: boxes over a page, and the graph of connections, as SVG and HTML texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom.operators import graph
from wireloom.sinks.netlists import _xml

# The colours of types, in order, and that of the unknown type.
PALETTE = ["#5b9dff", "#9fd88a", "#f2b366", "#d78bf0", "#7ec1ff", "#ff8c5a", "#78c8a0", "#f08282"]
RED = "#ff0000"
#: Sizes of the graph's cells in pixels.
CELL, RADIUS = 240, 80


def coloured(symbols: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Adds a colour: the palette's, by the type's place among the drawing's distinct types in order; red for the unknown."""
    place = F.dense_rank().over(Window.partitionBy("drawing_id").orderBy("type")) - 1
    colours = F.array(*map(F.lit, PALETTE))
    return symbols.withColumn("colour", F.when(F.col("type") == unknown, RED).otherwise(F.get(colours, F.pmod(place, F.lit(len(PALETTE))))))


def _joined(order: list[str], line) -> object:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "")


def overlays(symbols: DataFrame, pages: DataFrame) -> DataFrame:
    """(drawing_id, svg): each symbol's box with its id and type over the page (drawing_id, width, height); pages without symbols are bare."""
    n = lambda c: F.col(c).cast("string")
    box = F.concat(F.lit('<rect x="'), n("x0"), F.lit('" y="'), n("y0"), F.lit('" width="'), (F.col("x1") - F.col("x0")).cast("string"), F.lit('" height="'), (F.col("y1") - F.col("y0")).cast("string"), F.lit('" fill="none" stroke-width="2" stroke="'), F.col("colour"), F.lit('"/>'))
    label = F.concat(F.lit('<text x="'), (F.col("x0") + 2).cast("string"), F.lit('" y="'), F.greatest(F.lit(10), F.col("y0") - 4).cast("string"), F.lit('" font-size="10" fill="'), F.col("colour"), F.lit('">'), _xml(F.col("id")), F.lit(" "), _xml(F.col("type")), F.lit("</text>"))
    body = coloured(symbols).groupBy("drawing_id").agg(_joined(["idx"], F.concat(box, label)).alias("body"))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), n("width"), F.lit('" height="'), n("height"), F.lit('">'))
    return pages.join(body, "drawing_id", "left").select("drawing_id", F.concat(head, F.coalesce("body", F.lit("")), F.lit("</svg>")).alias("svg"))


def components(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(drawing_id, id, part, size): each symbol's component over edges (drawing_id, a, b), parts numbered by falling size, then least id."""
    of = graph.roots(edges, ["drawing_id"])
    named = symbols.select("drawing_id", "id").distinct().join(of.withColumnRenamed("node", "id"), ["drawing_id", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    sizes = named.groupBy("drawing_id", "root").agg(F.count("*").alias("size"))
    order = F.row_number().over(Window.partitionBy("drawing_id").orderBy(F.desc("size"), "root")) - 1
    return named.join(sizes.withColumn("part", order), ["drawing_id", "root"]).select("drawing_id", "id", "part", "size")


def laid_out(parts: DataFrame) -> DataFrame:
    """Adds x and y: components on a grid of as many columns as the root of their number, rounded up; a component's symbols on a circle."""
    sheet, part = Window.partitionBy("drawing_id"), Window.partitionBy("drawing_id", "part")
    columns = F.ceil(F.sqrt((F.max("part").over(sheet) + 1).cast("double"))).cast("int")
    angle = 2 * F.pi() * (F.row_number().over(part.orderBy("id")) - 1) / F.col("size")
    ring = F.when(F.col("size") > 1, F.lit(RADIUS)).otherwise(F.lit(0))
    x = (F.col("part") % columns) * CELL + CELL / 2 + ring * F.cos(angle)
    y = F.floor(F.col("part") / columns) * CELL + CELL / 2 + ring * F.sin(angle)
    return parts.withColumn("x", F.round(x, 2)).withColumn("y", F.round(y, 2))


def graphs(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(drawing_id, svg): symbols (drawing_id, id, type) as circles, connections (drawing_id, a, b) as lines, component by component."""
    once = edges.where("a != b").select("drawing_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    at = laid_out(components(symbols, once))
    n = lambda c: F.col(c).cast("string")
    ends = once.join(at.select("drawing_id", F.col("id").alias("a"), F.col("x").alias("x0"), F.col("y").alias("y0")), ["drawing_id", "a"])
    ends = ends.join(at.select("drawing_id", F.col("id").alias("b"), F.col("x").alias("x1"), F.col("y").alias("y1")), ["drawing_id", "b"])
    line = F.concat(F.lit('<line x1="'), n("x0"), F.lit('" y1="'), n("y0"), F.lit('" x2="'), n("x1"), F.lit('" y2="'), n("y1"), F.lit(f'" stroke="{PALETTE[0]}"/>'))
    nodes = at.join(coloured(symbols).select("drawing_id", "id", "type", "colour").dropDuplicates(["drawing_id", "id"]), ["drawing_id", "id"])
    node = F.concat(
        F.lit('<circle r="18" cx="'), n("x"), F.lit('" cy="'), n("y"), F.lit('" fill="'), F.col("colour"), F.lit('"/><text text-anchor="middle" font-size="9" x="'), n("x"), F.lit('" y="'), n("y"), F.lit('">'),
        _xml(F.col("id")), F.lit(" "), _xml(F.col("type")), F.lit("</text>"),
    )
    rows = ends.select("drawing_id", F.lit(0).alias("k"), line.alias("text")).unionByName(nodes.select("drawing_id", F.lit(1).alias("k"), node.alias("text")))
    body = rows.groupBy("drawing_id").agg(_joined(["k"], F.col("text")).alias("body"))
    grid = at.groupBy("drawing_id").agg((F.max("x") + CELL / 2).cast("int").cast("string").alias("w"), (F.max("y") + CELL / 2).cast("int").cast("string").alias("h"))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), F.col("w"), F.lit('" height="'), F.col("h"), F.lit('">'))
    return body.join(grid, "drawing_id").select("drawing_id", F.concat(head, "body", F.lit("</svg>")).alias("svg"))


def pages(symbols: DataFrame, edges: DataFrame, json: DataFrame) -> DataFrame:
    """(drawing_id, html): a table of a drawing's symbols with how many others each is connected to, its graph, and its JSON with keys and texts coloured."""
    once = edges.where("a != b").select("drawing_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = once.select("drawing_id", F.explode(F.array("a", "b")).alias("id")).groupBy("drawing_id", "id").agg(F.count("*").alias("degree"))
    rows = symbols.join(degree, ["drawing_id", "id"], "left")
    row = F.concat(F.lit("<tr><td>"), _xml(F.col("id")), F.lit("</td><td>"), _xml(F.col("type")), F.lit("</td><td>"), F.coalesce("degree", F.lit(0)).cast("string"), F.lit("</td></tr>"))
    table = rows.groupBy("drawing_id").agg(_joined(["idx"], row).alias("table"))
    text = F.regexp_replace(F.regexp_replace(_xml(F.col("json")), r"(&quot;[^&]*&quot;)(\s*:)", r"<b>$1</b>$2"), r"([:,\[]\s*)(&quot;[^&]*&quot;)", r"$1<i>$2</i>")
    both = json.join(table, "drawing_id", "left").join(graphs(symbols, edges), "drawing_id", "left")
    start = "<!DOCTYPE html><meta charset=utf-8><style>td{border:1px solid;padding:2px 6px}pre b{color:#2456a6}pre i{color:#2a7a3a}</style><table><tr><td>id</td><td>type</td><td>connected</td></tr>"
    return both.select("drawing_id", F.concat(F.lit(start), F.coalesce("table", F.lit("")), F.lit("</table>"), F.coalesce("svg", F.lit("")), F.lit("<pre>"), text, F.lit("</pre>")).alias("html"))
