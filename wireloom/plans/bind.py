"""Drawings made from the order tables, so that every operator has rows in both engines.

An order is a drawing and its lines are symbols; boxes, labels and nets follow from the lines' numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ORDER = "l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
_LABELS = ["R", "RV", "ZD", "C", "Q", "BATT", "TP", "$"]
_PARTS = ["BC547", "1N4148", "2N3904A", "4N26", "10K", "IR540"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with drawing_id and idx, the line's place in the order of all its columns."""
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("drawing_id", F.col("l_orderkey")).withColumn("idx", idx)


def gold(lines: DataFrame, *more: Column) -> DataFrame:
    """The lines' boxes and types; more: further expressions over the lines."""
    x0, y0 = F.expr("cast(l_partkey % 97 as int)"), F.expr("cast(l_suppkey * 13 % 61 as int)")
    return lines.select(
        "drawing_id", "idx", x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_quantity").cast("int")).alias("x1"),
        (y0 + 20 + 5 * F.col("l_linenumber")).cast("int").alias("y1"), F.col("l_returnflag").alias("type"), *more,
    )


def pred(lines: DataFrame) -> DataFrame:
    """The golden boxes shifted, some far away, some with another type."""
    dx = F.expr("cast(case when l_partkey % 13 = 0 then 60 when l_partkey % 11 = 0 then 10000 else 4 * (l_partkey % 7 - 3) end as int)")
    dy = F.expr("cast(l_suppkey % 5 - 2 as int)")
    moved = gold(lines, dx.alias("dx"), dy.alias("dy"), F.expr("l_partkey % 5 = 0").alias("swap"))
    return moved.select(
        "drawing_id", "idx", (F.col("x0") + F.col("dx")).alias("x0"), (F.col("y0") + F.col("dy")).alias("y0"),
        (F.col("x1") + F.col("dx")).alias("x1"), (F.col("y1") + F.col("dy")).alias("y1"), F.when(F.col("swap"), "X").otherwise(F.col("type")).alias("type"),
    )


def tokens(lines: DataFrame) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), F.expr("cast(l_partkey % 8 as int) + 1"))
    text = F.concat(label, F.expr("cast(l_suppkey % 40 as string)"), F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit("K"))
    at = gold(lines, text.alias("text"), F.expr("cast(l_partkey % 60 as int)").alias("dx"), F.expr("cast(l_suppkey % 30 as int)").alias("dy"))
    return at.select("drawing_id", F.col("idx").alias("ord"), "text", (F.col("x1") + F.col("dx")).alias("x0"), (F.col("y0") + F.col("dy")).alias("y0"), (F.col("x1") + F.col("dx") + 30).alias("x1"), (F.col("y0") + F.col("dy") + 10).alias("y1"))


def members(lines: DataFrame) -> DataFrame:
    """Which golden symbols meet in which net."""
    return lines.select("drawing_id", F.expr("cast(l_suppkey % 3 as int)").alias("net_ord"), "idx")


def predicted_members(lines: DataFrame) -> DataFrame:
    return lines.select("drawing_id", F.expr("cast((l_suppkey + case when l_partkey % 17 = 0 then 1 else 0 end) % 3 as int)").alias("net_ord"), "idx")


def co_members(nets: DataFrame) -> DataFrame:
    """(drawing_id, a, b): symbols that share a net."""
    a, b = nets.select("drawing_id", "net_ord", F.col("idx").alias("a")), nets.select("drawing_id", "net_ord", F.col("idx").alias("b"))
    return a.join(b, ["drawing_id", "net_ord"]).where("a < b").select("drawing_id", "a", "b")


def hints(lines: DataFrame) -> DataFrame:
    """What is written beside each symbol: a part number or value run together with a label, and noise."""
    part = F.element_at(F.array(*[F.lit(x) for x in _PARTS]), F.expr("cast(l_partkey % 6 as int) + 1"))
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), F.expr("cast(l_suppkey % 8 as int) + 1"))
    number = F.expr("cast(l_partkey % 9 as string)")
    text = F.when(F.expr("l_suppkey % 4 = 0"), F.concat(F.lit("t"), number, part)).otherwise(F.concat(F.lit("= ae "), F.lower(label), F.lit("-"), number, F.lit(" 10K ?")))
    return lines.select("drawing_id", "idx", text.alias("text"))


def evidence(lines: DataFrame) -> DataFrame:
    """Votes of up to four sources on each symbol's class."""
    one = lambda *v: F.struct(*[c.alias(n) for c, n in zip(v, ("source_ord", "source", "class_ord", "class", "score", "confidence"))])
    sure = F.round(F.col("l_discount") * 10, 3)
    votes = F.array(
        one(F.lit(0), F.lit("yolo"), F.lit(0), F.col("l_returnflag"), F.lit(1.0), sure),
        one(F.lit(1), F.lit("dinov2"), F.lit(0), F.col("l_linestatus"), F.expr("cast((l_partkey % 10) / 10.0 as double)"), F.lit(0.9).cast("double")),
        one(F.lit(1), F.lit("dinov2"), F.lit(1), F.col("l_returnflag"), F.expr("cast((l_suppkey % 10) / 10.0 as double)"), F.lit(0.9).cast("double")),
        one(F.lit(2), F.lit("text_prior"), F.lit(0), F.expr("case when l_partkey % 3 = 0 then 'N' when l_partkey % 3 = 1 then 'Z' end"), F.lit(1.0), F.lit(0.55).cast("double")),
    )
    return lines.select("drawing_id", "idx", F.explode(votes).alias("v")).select("drawing_id", "idx", "v.*")


def terminals(lines: DataFrame) -> DataFrame:
    """The left and right ends of each golden symbol, pointing outward or nowhere."""
    g = gold(lines)
    middle = F.expr("cast(floor((y0 + y1) / 2) as int)")
    ends = F.array(
        F.struct(F.lit(0).alias("idx"), F.col("x0").alias("x"), middle.alias("y"), F.lit(180.0).cast("double").alias("direction_deg")),
        F.struct(F.lit(1).alias("idx"), F.col("x1").alias("x"), middle.alias("y"), F.when(F.col("type") != "N", F.lit(0.0)).cast("double").alias("direction_deg")),
    )
    return g.select("drawing_id", F.col("idx").alias("symbol_id"), F.explode(ends).alias("t")).select("drawing_id", "symbol_id", "t.*")


def wire_points(lines: DataFrame) -> DataFrame:
    """A short horizontal stretch of wire beside each golden symbol."""
    g = gold(lines, F.expr("cast(l_suppkey % 3 as int)").alias("net_ord"))
    shift = F.explode(F.sequence(F.lit(0), F.lit(6)))
    return g.select("drawing_id", "net_ord", (F.col("x1") + 2 * F.col("net_ord") + 3).alias("x"), F.expr("cast(floor((y0 + y1) / 2) as int) + 2 * net_ord - 2").alias("y"), shift.alias("k")).select("drawing_id", "net_ord", (F.col("x") + 2 * F.col("k")).alias("x"), "y")


def crossings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pixels and dots of a drawing per customer: level strokes across an upright one, which may be dotted, end on it or miss it.

    How many there are, how long they are, where the upright one begins, and whether specks lie above and below follow from the customer's numbers.
    """
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS drawing_id", "cast(c_custkey % 3 as int) + 1 AS n", "cast(c_custkey % 5 as int) + 3 AS arm", "cast(c_nationkey % 4 as int) AS kind", "c_custkey % 7 AS speck")
    level = c.select("*", F.explode(F.expr("sequence(1, n)")).alias("j"), F.explode(F.expr("sequence(-arm, arm)")).alias("k"))
    level = level.where("kind < 3 or k >= j - 2").selectExpr("drawing_id", "20 * j AS y", "20 + k AS x")
    upright = c.select("*", F.explode(F.expr("sequence(case when kind = 2 then 20 else 12 end, 20 * n + arm)")).alias("y")).selectExpr("drawing_id", "y", "20 AS x")
    specks = c.where("speck < 2").selectExpr("drawing_id", "explode(case speck when 0 then array(2, 20 * n + 30) else array(4) end) AS y", "3 AS x")
    blot = c.where("speck = 3").select("drawing_id", F.explode(F.array(F.lit(3), F.lit(4))).alias("y")).select("drawing_id", "y", F.explode(F.array(F.lit(8), F.lit(9))).alias("x"))
    whole = level.union(upright).union(specks).union(blot).select("drawing_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    dots = c.where("kind = 1").select("drawing_id", "n", F.explode(F.expr("sequence(1, n)")).alias("j")).where("(drawing_id + j) % 2 = 0")
    return whole, dots.selectExpr("drawing_id", "cast(20 * j + 1 as int) AS y", "19 AS x")
