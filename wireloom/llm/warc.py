"""WARC archives and their chunked record table.

Writing: each task streams its rows into .warc.gz files in the shared folder, a gzip member per record,
payloads in CHUNK steps straight from the Arrow buffer.  Only a manifest of byte ranges
comes back; it is written before use, so that a lost executor doesn't write archives anew, and
files of failed attempts, which have names of their own, are in no manifest.

Reading: each manifest range is streamed, and a record comes out as rows (record, chunk_no) of
at most CHUNK payload bytes each, with the payload's size and SHA-256 so far.  No record is held whole.

Which payloads are equal is found from digests alone: an aggregate that combines before the shuffle.
Digests that repeat are broadcast if they are counted to be few; else ids alone are joined by digest, which a payload of very
many pages makes a hot key, and the rows then by id and digest.

Defined results: a null html is an empty payload.  A null page_id is never referred to while its
payload has another id.  Rows that repeat both the smallest id and its payload are all response: nothing tells them apart,
and a revisit would refer to its own id; repeats of a larger id are all revisits.  A null url is left out of the record.  Payloads of any
length are streamed; an empty table gives no archives and no rows; other columns are neither written nor returned.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm.shared import folder, kept

#: Payload bytes in a chunk.
CHUNK = 1 << 20
#: Payloads shorter than this are never revisits.
LEAST = 100
#: Bytes of archive after which a manifest range, and a file, end.
RANGE, FILE = 32 << 20, 1 << 30
#: Repeated digests, of 80 bytes each, that are still broadcast.
FEW = 1 << 18
#: Ranges that are read by a task each; of more, a task reads about eight.
READS = 1 << 14
#: The WARC-Date of records, as the pages carry none.
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "page_id long, record_type string, refers_to long, chunk_no int, payload_bytes long, payload_digest string, last boolean"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def head(page_id, url, digest: str, size: int, refers, date: str) -> bytes:
    """A record's WARC and HTTP headers; size is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + (size if refers is None else 0)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers is not None:
        fields.append(("WARC-Refers-To", f"<urn:page:{refers}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass") + http


def write(pages: DataFrame, to: str, chunk: int = CHUNK, least: int = LEAST, date: str = DATE, level: int = 1, few: int = FEW) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under the URI `to`; the manifest (file, start, size, records)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    same = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    same = kept(same.select("digest", "first"))
    refers = F.expr("if(page_id <=> first, null, first)").alias("refers")
    if same.count() <= few:
        rows = rows.join(F.broadcast(same), "digest", "left").select("page_id", "url", "html", "digest", refers)
    else:
        ids = rows.where("page_id is not null").select("page_id", "digest").distinct().join(same, "digest").select("page_id", "digest", refers)
        # a page without an id refers to its payload's first
        none = rows.where("page_id is null").select("url", "html", "digest").join(same, "digest", "left")
        none = none.select(F.lit(None).cast("long").alias("page_id"), "url", "html", "digest", F.col("first").alias("refers"))
        rows = rows.where("page_id is not null").join(ids, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers").unionByName(none)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(to)
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, start, n, files, done = None, 0, 0, 0, []
        name = ""
        for batch in batches:
            html = batch.column(2).cast(pa.large_binary())
            ids, urls, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for k in range(batch.num_rows):
                if out is None:
                    name = f"{task}-{files:04d}.warc.gz"
                    files, start, n = files + 1, 0, 0
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                payload = memoryview(html[k].as_buffer())
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(z.compress(head(ids[k], urls[k], digests[k], len(payload), refers[k], date)))
                if refers[k] is None:
                    for at in range(0, len(payload), chunk):
                        out.write(z.compress(payload[at : at + chunk]))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                n += 1
                if out.tell() - start >= RANGE:
                    done.append((name, start, out.tell() - start, n))
                    start, n = out.tell(), 0
                if out.tell() >= FILE:
                    out.close()
                    out = None
        if out is not None:
            if n:
                done.append((name, start, out.tell() - start, n))
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["file", "start", "size", "records"])

    return kept(rows.mapInArrow(make, "file string, start long, size long, records long"))


class Stream:
    """The uncompressed bytes of one archive range, a little at a time."""

    def __init__(self, source, size: int, step: int = 1 << 18):
        self.source, self.left, self.step = source, size, step
        self.z = zlib.decompressobj(31)
        self.raw, self.buffer = b"", b""

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data + self.raw, zlib.decompressobj(31)
            if not self.raw and self.left:
                self.raw = self.source.read(min(self.step, self.left))
                self.left -= len(self.raw)
            if not self.raw:
                return False
            got = self.z.decompress(self.raw, self.step)
            self.raw = self.z.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("an archive ends within a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def fields(self) -> tuple[str, dict[str, str]] | None:
        """The next block of header lines; none at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        first, *lines = self.take(at + 4)[:-4].decode("utf-8", "surrogatepass").split("\r\n")
        return first, {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def records(stream: Stream, chunk: int) -> Iterator[tuple]:
    """(page_id, record_type, refers_to, chunk_no, payload_bytes, payload_digest, last, data) per chunk of each record.

    Sizes and digests are of the payload so far, and in a revisit, which has no payload, the full payload's.
    """
    page = lambda uri: int(uri[10:-1]) if uri and uri != "<urn:page:>" else None
    while found := stream.fields():
        warc = found[1]
        named, kind = warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"]
        size = int(stream.fields()[1]["content-length"])
        row = page(warc["warc-record-id"]), kind, page(warc.get("warc-refers-to"))
        if kind == "revisit":
            yield *row, 0, size, named, True, b""
        else:
            digest, at, k = hashlib.sha256(), 0, 0
            while True:
                data = stream.take(min(chunk, size - at))
                digest.update(data)
                at += len(data)
                if at == size and digest.hexdigest() != named:
                    raise ValueError(f"the payload of {row[0]} isn't what its digest says")
                yield *row, k, at, digest.hexdigest(), at == size, data
                if at == size:
                    break
                k += 1
        stream.take(4)


def read(manifest: DataFrame, of: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk rows of the archives under the URI `of`; with `data` also the chunks' bytes."""
    names = [x.split()[0] for x in CHUNKS.split(", ")] + ["data"] * data
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * data

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(of)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{base}/{r['file']}") as f:
                    f.seek(r["start"])
                    rows, held = [], 0
                    for row in records(Stream(f, r["size"]), chunk):
                        rows.append(row[: len(names)])
                        held += len(row[-1]) if data else 0
                        if held >= 8 * chunk or len(rows) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ranges = manifest.count()
    # a number of its own, as the few small rows would else be read by one task
    return manifest.repartition(max(1, min(ranges, max(READS, ranges // 8)))).mapInArrow(make, CHUNKS + ", data binary" * data)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), at)
    return read(manifest, at, data=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
"""
