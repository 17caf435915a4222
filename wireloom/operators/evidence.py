"""Weighted evidence, nearest classes, and routing of close calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fused(evidence: DataFrame, weights: dict[str, float], by: list[str], default: float = 1.0) -> DataFrame:
    """Totals of weight x confidence x score: (by..., class, total, rank, margin).

    evidence: by..., source, source_ord, class_ord, class, score, confidence.  Sources without confidence abstain.
    Ties keep the class that comes first by source, then class order.  margin is the first's lead as a share of its
    total, 1 if it is alone or 0.  A class's votes, one a source at most, are added in the order of sources.
    """
    known = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]) if weights else F.create_map().cast("map<string,double>")
    weight = F.coalesce(known[F.col("source")], F.lit(default))
    votes = evidence.where("confidence > 0 and class is not null")
    vote = F.struct("source_ord", "class_ord", (weight * F.col("confidence") * F.col("score")).cast("double").alias("v"))
    sums = votes.groupBy(*by, "class").agg(F.sort_array(F.collect_list(vote)).alias("votes"))
    sums = sums.select(*by, "class", F.aggregate("votes", F.lit(0.0), lambda a, x: a + x["v"]).alias("total"), F.struct(F.col("votes")[0]["source_ord"], F.col("votes")[0]["class_ord"]).alias("first"))
    line = Window.partitionBy(*by).orderBy(F.desc("total"), "first")
    following = F.coalesce(F.lead("total").over(line), F.lit(0.0))
    ranked = sums.withColumn("rank", F.row_number().over(line)).withColumn("margin", F.when(F.col("total") == 0, 1.0).otherwise((F.col("total") - following) / F.col("total")))
    return ranked.drop("first")


def winners(candidates: DataFrame, ranked: DataFrame, by: list[str], unknown: str = "Unknown", most: int = 3) -> DataFrame:
    """Each candidate's class, score, margin and the ranking's head as text; candidates that nothing voted for are unknown."""
    few = ranked.where(F.col("rank") <= most)
    listed = F.sort_array(F.collect_list(F.struct("rank", "class")))
    top = few.groupBy(*by).agg(
        F.min_by("class", "rank").alias("class"), F.min_by("total", "rank").alias("score"), F.min_by("margin", "rank").alias("margin"),
        F.array_join(F.transform(listed, lambda x: x["class"]), ",").alias("top"),
    )
    out = candidates.join(top, by, "left")
    return out.select(*candidates.columns, F.coalesce("class", F.lit(unknown)).alias("class"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("margin", F.lit(1.0)).alias("margin"), F.coalesce("top", F.lit("")).alias("top"))


def routed(ranked: DataFrame, groups: list[tuple[str, list[str]]], by: list[str], most: int = 3) -> DataFrame:
    """(by..., route): the first group that holds a candidate's leading class, or two of its leading `most`; others have no row."""
    heads = ranked.where(F.col("rank") <= most).groupBy(*by).agg(F.collect_set("class").alias("classes"), F.min_by("class", "rank").alias("lead"))
    route = F.lit(None).cast("string")
    for name, members in reversed(groups):
        held = F.col("lead").isin(members) | (F.size(F.array_intersect("classes", F.array(*[F.lit(m) for m in members]))) >= 2)
        route = F.when(held, name).otherwise(route)
    return heads.select(*by, route.alias("route")).where("route is not null")


def nearest(queries: DataFrame, library: DataFrame, most: int = 20, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, label, similarity, rank): exact nearest by cosine, without the query itself; ties go to the smaller id.

    queries: query_id, v; library: vec_id, v, label.  Queries are taken in blocks of at most `block`, each sent to all
    tasks; a task keeps `most` rows a query while it reads its part of the library.  Vectors that are null, hold a null or
    aren't as long as most of the library's take no part.
    """
    spark = queries.sparkSession
    lengths = library.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, vec_id long, label int, similarity double, rank int")
    whole = (F.size("v") == lengths.d) & F.forall("v", lambda x: x.isNotNull())
    queries, library = queries.where(whole), library.where(whole)
    parts = max(1, -(-queries.count() // block))
    found = None
    for k in range(parts):
        few = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).orderBy("query_id").toArrow()
        ids = few.column("query_id").to_numpy()
        if not len(ids):
            continue
        q = unit(np.asarray(few.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1))
        held = spark.sparkContext.broadcast((ids, q))

        def make(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            best = [np.full((len(ids), most), -np.inf), np.full((len(ids), most), np.iinfo(np.int64).max), np.zeros((len(ids), most), np.int64)]
            for batch in batches:
                for at in range(0, batch.num_rows, step := max(1, (1 << 22) // len(ids))):
                    part = batch.slice(at, step)
                    v = unit(np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(part.num_rows, -1))
                    other, label = part.column(0).to_numpy(), part.column(2).to_numpy()
                    s = q @ v.T
                    s[other[None, :] == ids[:, None]] = -np.inf
                    # what reaches a query's last kept row, ties included
                    some = np.flatnonzero((s >= best[0][:, -1:] - 1e-9).any(axis=0))
                    columns = [np.concatenate((b, x), axis=1) for b, x in zip(best, (s[:, some], np.tile(other[some], (len(ids), 1)), np.tile(label[some].astype(np.int64), (len(ids), 1))))]
                    order = np.lexsort((columns[1], -np.round(columns[0], 9)), axis=1)[:, :most]
                    best = [np.take_along_axis(c, order, 1) for c in columns]
            good = np.isfinite(best[0])
            n = good.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best[1][good]), pa.array(best[2][good].astype(np.int32)), pa.array(best[0][good])], names=["query_id", "vec_id", "label", "similarity"])

        part = library.select("vec_id", "v", "label").mapInArrow(make, "query_id long, vec_id long, label int, similarity double")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, vec_id long, label int, similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def best_classes(near: DataFrame, floor: float, most: int = 3) -> DataFrame:
    """(query_id, rank, label, similarity, above): the best similarity of each class among the near rows, the first classes.

    The floor is applied after the ranking: `above` tells which classes reach it.
    """
    best = near.groupBy("query_id", "label").agg(F.max(F.round("similarity", 6)).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "label"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("above", F.col("similarity") >= floor)


def probe(rows: DataFrame, weights: np.ndarray, bias: np.ndarray, classes: list[str], most: int = 3) -> DataFrame:
    """(query_id, rank, class, probability): a linear probe's leading classes of rows (query_id, v). The weights are one small matrix."""
    held = rows.sparkSession.sparkContext.broadcast((np.asarray(weights, float), np.asarray(bias, float)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1) @ w.T + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            top = np.argsort(-p, axis=1, kind="stable")[:, :most]
            n = top.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(top))), pa.array([classes[k] for k in top.ravel()]), pa.array(np.take_along_axis(p, top, 1).ravel())],
                names=["query_id", "rank", "class", "probability"],
            )

    return rows.select("query_id", "v").mapInArrow(make, "query_id long, rank int, class string, probability double")


def template_of(winners: DataFrame, matched: DataFrame, library: DataFrame, by: list[str]) -> DataFrame:
    """Each winner's library entry: the one it matched (by..., class, entry), else the class's upright plain one, else its first.

    library: class, entry (its order), turn, mirrored.  Winners of a class without entries have a null entry.
    """
    plain = (F.col("turn") == 0) & ~F.col("mirrored")
    usual = library.groupBy("class").agg(F.min(F.struct((~plain).alias("odd"), "entry")).alias("e")).select("class", F.col("e.entry").alias("usual"))
    own = matched.groupBy(*by, "class").agg(F.min("entry").alias("own"))
    return winners.join(own, [*by, "class"], "left").join(usual, "class", "left").withColumn("entry", F.coalesce("own", "usual")).drop("own", "usual")
