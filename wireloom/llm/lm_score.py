"""Cross-entropy difference of matched bigram models.

A target model (over the target documents) and a background model (over all documents) share one
vocabulary, every lower-case word of the whole corpus, one order, and one smoothing: a bigram's
count is backed by `BACKING` draws from the smoothed unigram model.  Per token, the loss under the
target less that under the background is averaged over a document; low scores are like the target.
A document's own tokens are taken out of the counts of each model that holds them, so no document
is scored by what it taught.

Every token of every document is counted, and every word and bigram by itself (words by a 64-bit
hash, bigrams by one of both words').  The counts of words and pairs that are frequent in a sample
are combined per task and broadcast, at most COMMON and SLOTS of them.  All others grow with the
corpus and stay distributed: a document's rare pairs and contexts, each once with its own count,
are dealt by key (the word if that is rare, else the pair) in packed buckets, whose number grows
with the corpus, and summed where they meet.  A frequent key
is thus never dealt, and which are taken as frequent changes no score.

Defined results: a null, empty or blank text has no tokens and null losses and score.  Labels may
repeat an id: it is a target if any row makes it one.  Without targets the target
model is uniform.  Repeated documents are counted and scored each.  An empty table gives no rows.  Texts of any length
are read whole; a document's tokens, as numbers, are held at once.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm.shared import bounded, kept

#: Words and pairs, frequent in a sample, whose counts are broadcast; all others are joined.
COMMON = 1 << 17
SLOTS = 1 << 20
#: Documents from which the frequent ones are chosen.
SAMPLE = 1 << 13
BACKING = 8.0
#: Tokens or rows counted or scored at once.
STEP = 1 << 18
#: The id before a document's first word, where words are numbered by hash.
START = 1
#: Kinds of rows, in place of a frequent word's number.
RARE, CONTEXT = -1, -2
#: Tokens to a bucket of rare rows, of which there are so many at least; tokens whose rare rows are dealt at once.
SHARE, BUCKETS, HELD = 1 << 18, 1024, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A rare row as it is dealt: key, other word of the pair, document row, own count of the pair, of the word, kind, tokens of the document, target.
_ROW = [("key", "<i8"), ("sub", "<i8"), ("row", "<i8"), ("n", "<u4"), ("own", "<u4"), ("at", "<i4"), ("size", "<u4"), ("target", "u1")]


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def paired(before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of ids."""
    h = before.view(np.uint64) * _MIX + at.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where keys stand in the ascending known ones; -1 where they don't."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


@dataclass
class Model:
    """Counts of what is frequent, ascending by key, and totals; each count for the target, then the background."""

    #: Words to ids from 1 on, where the vocabulary was cut (0 is any other word, len + 1 a document's start); else None.
    ids: dict[bytes, int] | None
    words: np.ndarray
    pairs: np.ndarray
    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    total: np.ndarray
    size: int
    backing: float


def numbered(texts: list[str | None], ids: dict[bytes, int] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids before, ids) of all tokens, about STEP at a time; without ids, words are numbered by hash."""
    start = START if ids is None else len(ids) + 1
    get = xxhash.xxh3_64_intdigest if ids is None else lambda w: ids.get(w, 0)
    rows, parts, held = [], [], 0
    for i, t in enumerate(texts):
        found = words(t)
        if not found:
            continue
        rows.append((i, len(found)))
        parts.append(np.fromiter(map(get, found), dtype=np.uint64, count=len(found)).view(np.int64))
        held += len(found)
        if held >= STEP:
            yield joined(rows, parts, start)
            rows, parts, held = [], [], 0
    if rows:
        yield joined(rows, parts, start)


def joined(rows: list[tuple[int, int]], parts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate(parts)
    which, n = np.array(rows).T
    before = np.concatenate(([start], at[:-1]))
    before[np.cumsum(n)[:-1]] = start
    return np.repeat(which, n), before, at


def vocabulary(documents: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words of all documents, by falling count, then by the word."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(words(t))
                if len(held) > 200_000:
                    yield flush(held)
        if held:
            yield flush(held)

    def flush(held: Counter[bytes]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    found = documents.select("text").mapInArrow(make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): k for k, r in enumerate(found.orderBy(F.desc("n"), "word").limit(most).collect(), 1)}


def marks(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows with a column of whether they are a target."""
    ids = bounded(kept(targets.where("doc_id is not null").select("doc_id").distinct()), 16).withColumn("target", F.lit(True))
    return documents.join(ids, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))


def ranks(row: np.ndarray, before: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, a document's start last, and where in them each token's word and the one before it stand."""
    some, word = np.unique(at, return_inverse=True)
    context = np.concatenate(([len(some)], word[:-1]))
    context[1:][row[1:] != row[:-1]] = len(some)
    return np.append(some, before[0]), word, context


def record(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def frequent(documents: DataFrame, ids: dict[bytes, int] | None, common: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, and pairs that end in one of them, that are frequent in a sample of rows. Scores don't depend on the choice."""
    n = documents.count()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, before, at in numbered(batch.column(0).to_pylist(), ids):
                key, n = np.unique(at, return_counts=True)
                yield record(pair=np.zeros(len(key), bool), key=key, at=key, n=n)
                key, first, n = np.unique(paired(before, at), return_index=True, return_counts=True)
                yield record(pair=np.ones(len(key), bool), key=key, at=at[first], n=n)

    few = documents.select("text").sample(min(1.0, SAMPLE / max(n, 1)), seed=1) if n > SAMPLE else documents.select("text")
    found = few.mapInArrow(make, "pair boolean, key long, at long, n long").groupBy("pair", "key").agg(F.min("at").alias("at"), F.sum("n").alias("n"))
    found = kept(found.where("n > 1"))
    top = [found.where(f"pair = {x}").orderBy(F.desc("n"), "key").limit(most).toArrow() for x, most in (("false", common), ("true", slots))]
    key, pair, at = (np.asarray(t.column(c).to_numpy(), dtype=np.int64) for t, c in ((top[0], "key"), (top[1], "key"), (top[1], "at")))
    # a document's start is a context of every document
    start = START if ids is None else len(ids) + 1
    return np.unique(np.append(key, start)), np.sort(pair[np.isin(at, key)])


def train(documents: DataFrame, targets: DataFrame, most: int | None = None, common: int = COMMON, slots: int = SLOTS, backing: float = BACKING) -> Model:
    """Totals and the counts of what is frequent; targets holds the target documents' doc_id. most: cuts the vocabulary."""
    spark = documents.sparkSession
    ids = None if most is None else vocabulary(documents, most)
    known, pairs = frequent(documents, ids, common, slots)
    held = spark.sparkContext.broadcast((ids, known, pairs))
    n = len(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # target and background: all tokens, then frequent words, contexts and pairs
        ids, known, pairs = held.value
        sums, rare, size = np.zeros((2, 1 + 2 * n + len(pairs)), dtype=np.int64), [], 0
        for batch in batches:
            chosen = np.array(batch.column(1).to_pylist(), dtype=bool)
            for row, before, at in numbered(batch.column(0).to_pylist(), ids):
                some, word, context = ranks(row, before, at)
                where = places(known, some)
                word, context, pair = where[word], where[context], places(pairs, paired(before, at))
                for k, use in enumerate((chosen[row], slice(None))):
                    hits = [x[use] for x in (word, context, pair)]
                    hits = [x[x >= 0] + start for x, start in zip(hits, (1, 1 + n, 1 + 2 * n))]
                    sums[k] += np.bincount(np.concatenate(hits), minlength=sums.shape[1])
                    sums[k, 0] += len(word[use])
                rare.append(np.unique(at[word < 0]))
                size += len(rare[-1])
                if size > 8 * STEP:
                    yield from flush(rare)
                    size = 0
        yield from flush(rare)
        some = np.flatnonzero(sums[1])
        for k in range(0, len(some), 100_000):
            at = some[k : k + 100_000]
            yield record(rare=np.zeros(len(at), bool), key=at, target=sums[0][at], background=sums[1][at])

    def flush(rare: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.unique(np.concatenate([np.zeros(0, np.int64), *rare]))
        rare.clear()
        for k in range(0, len(key), 100_000):
            at = key[k : k + 100_000]
            none = np.zeros(len(at), np.int64)
            yield record(rare=none == 0, key=at, target=none, background=none)

    found = marks(documents.select("doc_id", "text"), targets).select("text", "target").mapInArrow(count, "rare boolean, key long, target long, background long")
    found = found.groupBy("rare", "key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    found = found.groupBy("rare", F.expr("if(rare, null, key)").alias("key")).agg(F.sum("target").alias("target"), F.sum("background").alias("background"), F.count("*").alias("n"))
    # at most 1 + 2 * COMMON + SLOTS rows, and one that counts the rare words
    counts = found.toArrow()
    rare = counts.column("rare").to_numpy()
    size = int(counts.column("n").to_numpy()[rare].sum()) + n - 1 if ids is None else len(ids)
    counts = counts.filter(pa.array(~rare))
    sums = np.zeros((2, 1 + 2 * n + len(pairs)))
    for k, name in enumerate(("target", "background")):
        sums[k, counts.column("key").to_numpy()] = counts.column(name).to_numpy()
    return Model(ids, known, pairs, sums[:, 1 : 1 + n], sums[:, 1 + n : 1 + 2 * n], sums[:, 1 + 2 * n :], sums[:, 0], size + 2, backing)


def numerators(m: Model, pair: np.ndarray, word: np.ndarray, n: np.ndarray, own: np.ndarray, size: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Per model, bits of n tokens' numerators; mine: per model whether the document's own counts are in it."""
    unigram = (word - own * mine + 1) / (m.total[:, None] - size * mine + m.size)
    return -n * np.log2(pair - n * mine + m.backing * unigram)


def score(documents: DataFrame, targets: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, the mean losses in bits and their difference, for every row."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's frequent part as one row, and its rare pairs and contexts, packed by bucket."""
        m = held.value
        parts, tokens = [], 0
        for batch in batches:
            chosen = np.array(batch.column(3).to_pylist(), dtype=bool)
            ids = batch.column(0).to_numpy()
            sums, sizes = np.zeros((2, batch.num_rows)), np.zeros(batch.num_rows, dtype=np.int64)
            for row, before, at in numbered(batch.column(2).to_pylist(), m.ids):
                sizes += np.bincount(row, minlength=batch.num_rows)
                some, word, context = ranks(row, before, at)
                where, wide = places(m.words, some), len(some)
                _, to, n = np.unique(row * wide + word, return_inverse=True, return_counts=True)
                own = n[to]
                _, first, n = np.unique((row * wide + context) * wide + word, return_index=True, return_counts=True)
                r, at1, own = row[first], where[word[first]], own[first]
                key = paired(before[first], at[first])
                place = np.where(at1 >= 0, places(m.pairs, key), -1)
                mine = np.array([chosen[r], np.ones(len(r), bool)])
                hot = place >= 0
                bits = numerators(m, m.pair[:, place[hot]], m.word[:, at1[hot]], n[hot], own[hot], sizes[r[hot]], mine[:, hot])
                for k in range(2):
                    sums[k] += np.bincount(r[hot], weights=bits[k], minlength=batch.num_rows)
                rare = at1 < 0
                other = where[context[first]]
                other = np.where(other >= 0, other, before[first])
                columns = np.where(rare, at[first], key), np.where(rare, other, 0), ids[r], n, own, at1, sizes[r], chosen[r]
                parts.append([x[~hot] for x in columns])
                # pairs stand in order of row and context
                edge = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (context[first][1:] != context[first][:-1]))))
                n, first = np.add.reduceat(n, edge), first[edge]
                r, at1 = row[first], where[context[first]]
                hot = at1 >= 0
                mine = np.array([chosen[r], np.ones(len(r), bool)])
                bits = n[hot] * np.log2(m.context[:, at1[hot]] - n[hot] * mine[:, hot] + m.backing)
                for k in range(2):
                    sums[k] += np.bincount(r[hot], weights=bits[k], minlength=batch.num_rows)
                none = np.zeros(len(r), np.int64)
                parts.append([x[~hot] for x in (before[first], none, ids[r], n, none, none + CONTEXT, sizes[r], chosen[r])])
                tokens += len(at)
                if tokens >= HELD:
                    yield packed(parts, buckets)
                    parts, tokens = [], 0
            doc = pa.StructArray.from_arrays([*map(pa.array, (ids, sizes)), batch.column(1).cast(pa.int64()), *map(pa.array, sums)], fields=list(DOC))
            yield pa.RecordBatch.from_arrays([pa.array(ids % buckets), pa.nulls(len(ids), pa.binary()), doc], names=["bucket", "rows", "doc"])
        if parts:
            yield packed(parts, buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Losses of rows that come in order of bucket."""
        m = held.value
        parts, size, last = [], 0, None
        for batch in batches:
            doc = batch.column(2).drop_null()
            if len(doc):
                yield pa.RecordBatch.from_arrays(doc.flatten(), names=OUT)
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rows is None:
                    continue
                if bucket != last and size >= STEP:
                    yield losses(m, *map(np.concatenate, zip(*parts)))
                    parts, size = [], 0
                last = bucket
                parts.append(unpacked(rows))
                size += len(parts[-1][0])
        if size:
            yield losses(m, *map(np.concatenate, zip(*parts)))

    buckets = max(BUCKETS, int(model.total[1]) // SHARE)
    marked = marks(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), targets).select("row", "doc_id", "text", "target")
    schema = "bucket long, rows binary, doc struct<row: long, n_tokens: long, doc_id: long, target_loss: double, background_loss: double>"
    met = marked.mapInArrow(emit, schema).repartition("bucket").sortWithinPartitions("bucket")
    met = met.mapInArrow(meet, "row long, n_tokens long, doc_id long, target_loss double, background_loss double")
    found = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("target_loss").alias("t"), F.sum("background_loss").alias("b"))
    n = F.expr("nullif(n_tokens, 0)")
    return found.select("doc_id", "n_tokens", (F.col("t") / n).alias("target_loss"), (F.col("b") / n).alias("background_loss"), ((F.col("t") - F.col("b")) / n).alias("score"))


OUT = ["row", "n_tokens", "doc_id", "target_loss", "background_loss"]
DOC = pa.struct([*((x, pa.int64()) for x in OUT[:3]), *((x, pa.float64()) for x in OUT[3:])])


def packed(parts: list[list[np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Rare rows as one value a bucket: a column after the other, by kind and document, each byte by byte, as it compresses best."""
    columns = [np.concatenate(x) for x in zip(*parts)]
    # keys are spread, one to one, and a bucket is a span of them, so that its keys share their first bits, which compress to nothing
    columns[0] = (columns[0].view(np.uint64) * _MIX).view(np.int64)
    bucket = ((columns[0].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((np.minimum(columns[5], 0), bucket))
    bucket = bucket[order]
    columns = [x[order].astype(kind) for x, (_, kind) in zip(columns, _ROW)]
    row = columns[2].copy()
    columns[2][1:] = np.diff(row)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    columns[2][edges[:-1]] = row[edges[:-1]]
    values = [b"".join(x[a:b].view(np.uint8).reshape(b - a, -1).T.tobytes() for x in columns) for a, b in zip(edges[:-1], edges[1:])]
    values = [len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in values]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(values, pa.binary()), pa.nulls(len(values), DOC)], names=["bucket", "rows", "doc"])


def unpacked(rows: bytes) -> list[np.ndarray]:
    kinds = [np.dtype(kind) for _, kind in _ROW]
    rows = pa.decompress(rows[8:], int.from_bytes(rows[:8], "little"), "zstd", asbytes=True)
    n = len(rows) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        planes = np.frombuffer(rows, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(k))
        at += n * k.itemsize
    out[2] = np.cumsum(out[2])
    return out


def losses(m: Model, key: np.ndarray, sub: np.ndarray, row: np.ndarray, n: np.ndarray, own: np.ndarray, at: np.ndarray, size: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    """The losses of rare rows whose keys are all there, a row each."""
    order = np.lexsort((sub, key))
    key, sub, row, n, own, at, size, target = (x[order] for x in (key, sub, row, n.astype(np.int64), own.astype(np.int64), at, size.astype(np.int64), target))
    other = key[1:] != key[:-1]
    run = np.cumsum(np.concatenate(([0], other)))
    pair = np.cumsum(np.concatenate(([0], other | (sub[1:] != sub[:-1]))))
    context, rare = at == CONTEXT, at == RARE
    mine = np.array([target.astype(bool), np.ones(len(key), bool)])
    total = lambda of, use: np.array([np.bincount(of, weights=n * x * use)[of] for x in mine])
    contexts, alone, pairs = total(run, context), total(run, rare), total(pair, ~context)
    word = np.where(at >= 0, m.word[:, np.maximum(at, 0)], alone) if len(m.words) else alone
    bits = np.zeros((2, len(key)))
    bits[:, ~context] = numerators(m, *(x[..., ~context] for x in (pairs, word, n, own, size, mine)))
    bits[:, context] = n[context] * np.log2(contexts[:, context] - n[context] * mine[:, context] + m.backing)
    none = pa.nulls(len(row), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(row), none, none, *map(pa.array, bits)], names=OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are the documents labelled as good and not as toxic."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    targets = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    return score(documents, targets, train(documents, targets))
