"""Scoring of detection, classification and connectivity against golden drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions.geometry import rates, ratio
from wireloom.operators.boxes import iou_pairs
from wireloom.operators.matching import greedy
from wireloom.sources import drawings

BY = "drawing_id"


def matches(gold: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matches by falling overlap, ties by golden then predicted index."""
    pairs = iou_pairs(gold, pred, least).select(BY, F.col("a_idx").alias("gi"), F.col("b_idx").alias("pi"), F.col("a_type").alias("gold_type"), F.col("b_type").alias("pred_type"), "iou")
    return greedy(pairs, [BY, "gi"], [BY, "pi"], [-F.col("iou"), F.col("gi"), F.col("pi")])


def detection(gold: DataFrame, pred: DataFrame, found: DataFrame) -> DataFrame:
    """Per drawing and in TOTAL (ratios of sums): counts, precision, recall, f1 and accuracy of the matched."""
    n = lambda df, name: df.groupBy(BY).agg(F.count("*").alias(name))
    hit = found.groupBy(BY).agg(F.count("*").alias("tp"), F.sum((F.col("gold_type") == F.col("pred_type")).cast("long")).alias("correct"))
    # a drawing is scored if it has both a golden and a predicted file
    each = n(gold, "n_gold").join(n(pred, "n_pred"), BY).join(hit, BY, "left").na.fill(0, ["tp", "correct"])
    sums = each.rollup(BY).agg(*[F.sum(c).alias(c) for c in ("n_gold", "n_pred", "tp", "correct")])
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gold") - F.col("tp")
    p, r, f1 = rates(tp, fp, fn)
    scope = F.coalesce(F.col(BY).cast("string"), F.lit("TOTAL"))
    shares = [c.alias(name) for c, name in ((p, "precision"), (r, "recall"), (f1, "f1"), (ratio(F.col("correct"), tp), "accuracy"))]
    return sums.select(scope.alias("scope"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), "correct", *shares)


def confusions(found: DataFrame) -> DataFrame:
    """How often matched pairs' types differ."""
    return found.where("gold_type != pred_type").groupBy("gold_type", "pred_type").agg(F.count("*").alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges (drawing_id, a, b) without loops, a first."""
    return edges.where("a != b").select(BY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connectivity(gold: DataFrame, pred: DataFrame, found: DataFrame) -> DataFrame:
    """Per drawing and in TOTAL: pairs connected in both (tp), predicted only (fp), golden only (fn), and rates.

    gold and pred hold undirected edges over symbol indices; only those whose ends are both matched count.
    """
    a, b = (found.select(BY, F.col(x).alias(e), F.col(y).alias(f"{e}2")) for x, y, e in (("gi", "pi", "a"), ("gi", "pi", "b")))
    moved = undirected(gold.join(a, [BY, "a"]).join(b, [BY, "b"]).select(BY, F.col("a2").alias("a"), F.col("b2").alias("b")))
    one = found.select(BY, F.col("pi").alias("a"))
    there = undirected(pred).join(one, [BY, "a"], "left_semi").join(one.withColumnRenamed("a", "b"), [BY, "b"], "left_semi").select(BY, "a", "b")
    kinds = [("tp", moved.intersect(there)), ("fn", moved.exceptAll(there)), ("fp", there.exceptAll(moved))]
    rows = None
    for name, df in kinds:
        df = df.select(BY, F.lit(name).alias("kind"))
        rows = df if rows is None else rows.union(df)
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    sums = rows.rollup(BY).agg(count("tp"), count("fp"), count("fn"))
    p, r, f1 = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(F.coalesce(F.col(BY).cast("string"), F.lit("TOTAL")).alias("scope"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def edges(symbols: DataFrame) -> DataFrame:
    """Undirected edges over indices from symbols' connections, which name ids; of symbols that share an id the last counts."""
    at = symbols.groupBy(BY, "id").agg(F.max("idx").alias("n"))
    named = symbols.select(BY, "id", F.explode("connections").alias("other"))
    ends = named.join(at, [BY, "id"]).join(at.select(BY, F.col("id").alias("other"), F.col("n").alias("m")), [BY, "other"])
    return undirected(ends.select(BY, F.col("n").alias("a"), F.col("m").alias("b")))


def from_files(spark: SparkSession, golden: str, predicted: str, least: float = 0.5) -> dict[str, DataFrame]:
    """Scores predicted drawings (JSON files) against golden ones of the same name.

    detection, confusions, unmatched_golden and unmatched_predicted of all that have both files; connectivity of those whose
    connections are verified; missing: golden drawings without a prediction.
    """
    gold_files, pred_files = drawings.drawings(spark, golden), drawings.drawings(spark, predicted)
    both = gold_files.select(BY, "verified").join(pred_files.select(BY), BY).distinct()
    gold, pred = (drawings.symbols(f).drop("verified").join(both, BY) for f in (gold_files, pred_files))
    boxed = [df.select(BY, "idx", "x0", "y0", "x1", "y1", "type") for df in (gold, pred)]
    found = matches(*boxed, least)
    left = lambda df, n: df.select(BY, F.col("idx").alias(n), "id").join(found, [BY, n], "left_anti").select(BY, "id")
    checked = found.join(both.where("verified"), BY, "left_semi")
    return {
        "detection": detection(*boxed, found),
        "confusions": confusions(found),
        "connectivity": connectivity(edges(gold.where("verified")), edges(pred.where("verified")), checked),
        "unmatched_golden": left(gold, "gi"),
        "unmatched_predicted": left(pred, "pi"),
        "missing": gold_files.select(BY).join(pred_files.select(BY), BY, "left_anti"),
    }
