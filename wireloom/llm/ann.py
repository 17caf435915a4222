"""Nearest neighbours by an inverted file with product-quantised residuals.

The coarse centroids and the codebooks of the residuals' subspaces are fitted on a bounded
sample (SAMPLE rows, first by a hash of their id and vector); every row is indexed.  There are about as many lists as the square root of the
rows: up to LISTS coarse centroids, each with the same finer ones around it where more lists are wanted than the sample
can fit.  The number of lists that a
query probes is fitted on the sample too, with queries that the centroids haven't seen: the fewest lists that hold REACH of the true
neighbours within the sample; a query whose lists hold too few rows goes on to further lists.

Small lists share a bundle; a list of more rows than a bundle holds is dealt into blocks, and a bundle's queries into blocks too, so a
list may hold any share of the rows or queries; each pair of blocks is one bounded group.  There, a table of
inner products of the query with the codebooks (asymmetric distances) ranks the codes of the rows in the lists that it probes, those
near the best are ranked again by exact inner products in double precision, and the best TOP go on.
Equal vectors share a code and are ranked once; of them the TOP + 1 smallest ids go on, more can't be among the nearest.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id take no part.
Rows are told apart by themselves, not by id: each row of a repeated id is a candidate, and if its id is a query's, a query of its own.
Vectors of different lengths have no inner product: each length is searched by itself (an index for each).  Scores tie to the smaller id.  An
empty table gives no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wireloom.llm.shared import kept

TOP = 20
#: Queries are the rows whose id this divides.
EVERY = 20
SAMPLE = 16384
#: Lists: the rows to this power. Coarse centroids: this many at most, and one for 16 rows of the sample.
POWER, LISTS = 0.5, 1024
REACH = 0.97
#: Rows ranked exactly: those whose asymmetric score is at most so many standard errors below the TOP-th best, and SHORTLIST at least.
ERRORS = 2.0
SHORTLIST = 64
#: Rows and queries in a group, at most; groups of a search, at least.
ROWS, QUERIES, GROUPS = 1 << 13, 1 << 12, 24
#: Scores that are held at once.
STEP = 1 << 20


@dataclass
class Index:
    centroids: np.ndarray
    #: Offsets from each centroid; a list is a centroid with an offset.
    finer: np.ndarray
    #: Per subspace its first and last dimension and its codebook.
    books: list[tuple[int, int, np.ndarray]]
    probes: int
    #: Standard error of the asymmetric score for a query of length 1.
    error: float = 0.0

    @property
    def lists(self) -> int:
        return len(self.centroids) * len(self.finer)

    def center(self, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists // len(self.finer)] + self.finer[lists % len(self.finer)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = nearest(x, self.centroids)
        return at * len(self.finer) + nearest(x - self.centroids[at], self.finer)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = x - self.center(lists)
        return np.column_stack([nearest(r[:, a:b], book) for a, b, book in self.books]).astype(np.uint8)

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Per query and list the inner product with the list's center."""
        return ((q @ self.centroids.T)[:, :, None] + (q @ self.finer.T)[:, None, :]).reshape(len(q), -1)

    def probe(self, q: np.ndarray, sizes: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
        """Per query the lists whose centers have the largest inner products with it; more if they hold fewer rows than `least`."""
        out = []
        for k in range(0, len(q), step := max(1, (1 << 22) // self.lists)):
            near = self.scores(q[k : k + step])
            some = np.argpartition(-near, self.probes - 1, axis=1)[:, : self.probes] if self.probes < self.lists else np.tile(np.arange(self.lists), (len(near), 1))
            for one, lists in zip(near, some):
                if sizes is not None and sizes[lists].sum() < least and len(lists) < self.lists:
                    order = np.argsort(-one, kind="stable")
                    lists = order[: np.searchsorted(np.cumsum(sizes[order]), least) + 1]
                out.append(np.sort(lists))
        return out


def nearest(x: np.ndarray, centers: np.ndarray, step: int = 4096) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (centers * centers).sum(axis=1) / 2
    for k in range(0, len(x), step):
        out[k : k + step] = (half - x[k : k + step] @ centers.T).argmin(axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centers from the first k distinct rows on; a center without rows stays where it was."""
    _, first = np.unique(x, axis=0, return_index=True)
    centers = x[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def fit(x: np.ndarray, rows: int) -> Index:
    """An index for `rows` vectors, fitted on the sample x."""
    lists = max(1, round(rows**POWER))
    # the last quarter only asks
    seen = x[: max(1, 3 * len(x) // 4)]
    centroids = k_means(seen, max(1, min(LISTS, lists, len(x) // 16 or 1)))
    r = seen - centroids[nearest(seen, centroids)]
    more = lists // LISTS if len(centroids) == LISTS else 1
    finer = k_means(r, min(more, LISTS)) if more > 1 else np.zeros((1, x.shape[1]))
    index = Index(centroids, finer, [], 1)
    r = (seen - index.center(index.assign(seen)))[:8192]
    edges = np.linspace(0, x.shape[1], max(1, x.shape[1] // 4) + 1).astype(int)
    index.books = [(a, b, k_means(r[:, a:b], 256, 6)) for a, b in zip(edges[:-1], edges[1:])]
    miss = r - np.column_stack([book[nearest(r[:, a:b], book)] for a, b, book in index.books])
    index.error = float(np.sqrt((miss * miss).sum(axis=1).mean() / x.shape[1]))
    _, first = np.unique(x, axis=0, return_index=True)
    first = np.sort(first)
    some = x[first]
    q = some[-min(256, max(1, len(some) // 4)) :]
    place = np.argsort(np.argsort(-index.scores(q), axis=1, kind="stable"), axis=1)
    best = np.argsort(-(q @ some.T), axis=1)[:, 1 : TOP + 1]
    need = np.sort(np.take_along_axis(place, index.assign(some)[best], 1).ravel())
    index.probes = int(need[int(np.ceil(REACH * len(need))) - 1]) + 1 if len(need) else index.lists
    return index


def valid(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v) of the rows that take part; row tells them apart once the table is kept."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", "embedding")
    rows = rows.where(good & F.exists("embedding", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, size)


def search(embeddings: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of the rows whose id `every` divides."""
    rows = kept(valid(embeddings))
    # a row for each length of vectors, of which a table has one or a few
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    found = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for k, s in enumerate(sizes):
        part = searched(rows.where(F.size("v") == s.d) if len(sizes) > 1 else rows, s.d, s.n, top, every)
        found = found.unionByName(part) if k else part
    return found


def searched(rows: DataFrame, d: int, n: int, top: int, every: int) -> DataFrame:
    """search() among n kept rows of vectors of length d."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).select("v").toArrow()
    x = np.asarray(sample.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(-1, d)
    index = fit(x, n)
    held = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten(), dtype=np.float64).reshape(-1, d)
            at = held.value.assign(x)
            codes = held.value.codes(x, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["row", "vec_id", "list", "code", "v"],
            )

    placed = kept(rows.mapInArrow(place, "row long, vec_id long, list int, code binary, v binary"))
    # a row for each list, about the square root of the table's rows
    many = np.zeros(index.lists, dtype=np.int64)
    for r in placed.groupBy("list").count().collect():
        many[r["list"]] = r["count"]
    bundle, shares = bundles(many, ROWS)
    filled = spark.sparkContext.broadcast((many, bundle))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and bundle that holds lists which it probes."""
        many, bundle = filled.value
        for batch in batches:
            q = np.asarray(batch.column(2).flatten(), dtype=np.float64).reshape(-1, d)
            who, where, which = [], [], []
            for i, lists in enumerate(held.value.probe(q, many, top + 1)):
                lists = lists[many[lists] > 0]
                lists = lists[np.argsort(bundle[lists], kind="stable")]
                some, start = np.unique(bundle[lists], return_index=True)
                who += [i] * len(some)
                where += some.tolist()
                which += [x.tolist() for x in np.split(lists, start[1:])] if len(some) else []
            at = pa.array(who, pa.int64())
            raw = pa.array([r.tobytes() for r in q], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), raw.take(at), pa.array(where, pa.int32()), pa.array(which, pa.list_(pa.int32()))], names=["asker", "query_id", "q", "bundle", "lists"])

    asked = kept(rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(ask, "asker long, query_id long, q binary, bundle int, lists array<int>"))
    wanted = dict(map(tuple, asked.groupBy("bundle").count().collect()))
    least = -(-GROUPS // max(1, len(wanted)))
    dealt = [(k, int(shares[k]), max(-(-n // QUERIES), min(n, least))) for k, n in sorted(wanted.items())]
    # a row for each bundle, and for each list, about the square root of the table's rows
    dealt = F.broadcast(spark.createDataFrame(dealt, "bundle int, shares int, turns int"))
    of = F.broadcast(spark.createDataFrame([(k, int(bundle[k])) for k in np.flatnonzero(many).tolist()], "list int, bundle int"))
    left = placed.join(of, "list").join(dealt, "bundle").withColumn("block", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int"))
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("shares", "turns")
    right = asked.join(dealt, "bundle").withColumn("turn", F.pmod(F.xxhash64("asker"), F.col("turns")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares", "turns")
    by = ["bundle", "block", "turn"]

    def group(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, int),) * 4 + (np.zeros(0),)]
        if rows.num_rows and queries.num_rows:
            row, ids, lists = (rows.column(c).to_numpy() for c in ("row", "vec_id", "list"))
            order = np.lexsort((row, ids, lists))
            row, ids, lists = row[order], ids[order], lists[order]
            v = matrix(rows.column("v").combine_chunks(), d)[order]
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            _, first, of = np.unique(v.view(np.dtype((np.void, 8 * d))).ravel(), return_index=True, return_inverse=True)
            # distinct vectors in order of list, and the members of each, smallest ids first
            place = np.argsort(first, kind="stable")
            first, of = first[place], np.argsort(place)[of]
            members = np.argsort(of, kind="stable")
            count = np.bincount(of)
            starts = np.cumsum(count) - count
            v, code, lists = v[first], np.ascontiguousarray(code[first].T), lists[first]
            known, edge = np.unique(lists, return_index=True)
            edge = np.append(edge, len(lists))
            centers = held.value.center(known)
            asker, query_id = queries.column("asker").to_numpy(), queries.column("query_id").to_numpy()
            q = matrix(queries.column("q").combine_chunks(), d)
            probed = np.zeros((len(q), len(known)), dtype=bool)
            flat = queries.column("lists").combine_chunks()
            at = np.searchsorted(known, flat.flatten().to_numpy())
            hit = known[np.minimum(at, len(known) - 1)] == flat.flatten().to_numpy()
            probed[np.repeat(np.arange(len(q)), np.diff(flat.offsets.to_numpy()))[hit], at[hit]] = True
            for k in range(0, len(q), step := max(1, STEP // len(first))):
                part = q[k : k + step]
                tables = [part[:, a:b] @ book.T for a, b, book in held.value.books]
                base = part @ centers.T
                near = np.full((len(part), len(first)), -np.inf)
                for n, (a, b) in enumerate(zip(edge, edge[1:])):
                    some = np.flatnonzero(probed[k : k + step, n])
                    if len(some):
                        total = np.repeat(base[some, n][:, None], b - a, 1)
                        for m, table in enumerate(tables):
                            total += table[some[:, None], code[m, a:b]]
                        near[some, a:b] = total
                good = np.isfinite(near)
                if len(first) > SHORTLIST:
                    best = -np.partition(-near, (top - 1, SHORTLIST - 1), axis=1)
                    reach = best[:, top - 1] - ERRORS * held.value.error * np.sqrt((part * part).sum(axis=1))
                    good &= near >= np.minimum(reach, best[:, SHORTLIST - 1])[:, None]
                i, j = np.nonzero(good)
                exact = (v[j] * part[i]).sum(axis=1)
                keep = heads(i, np.lexsort((-exact, i)), top + 1)
                i, j, exact = i[keep], j[keep], exact[keep]
                # each distinct vector's first members
                n = np.minimum(count[j], top + 1)
                member = members[np.repeat(starts[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                i, exact = np.repeat(i, n), np.repeat(exact, n)
                other = row[member] != asker[k + i]
                i, exact, member = i[other], exact[other], member[other]
                keep = heads(i, np.lexsort((row[member], ids[member], -exact, i)), top)
                i, exact, member = i[keep], exact[keep], member[keep]
                found.append((asker[k + i], query_id[k + i], ids[member], row[member], exact))
        return pa.table(dict(zip(("asker", "query_id", "vec_id", "row", "score"), map(np.concatenate, zip(*found)))))

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(group, "asker long, query_id long, vec_id long, row long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def bundles(many: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each list's bundle, so that lists next to one another share one up to `most` rows, and into how many blocks each bundle's rows are dealt."""
    bundle, filled = np.zeros(len(many), dtype=np.int64), [0]
    for k, n in enumerate(many.tolist()):
        if filled[-1] and filled[-1] + n > most:
            filled.append(0)
        bundle[k] = len(filled) - 1
        filled[-1] += n
    return bundle, np.maximum(-(-np.array(filled) // most), 1)


def heads(group: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of rows in order (group by group, ascending) the first so many of each group."""
    g = group[order]
    start = np.searchsorted(g, g, "left")
    return order[np.arange(len(g)) - start < most]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
