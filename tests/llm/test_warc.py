import gzip
import hashlib
import uuid

import duckdb
import pandas as pd
import pytest

from wireloom.llm import warc
from wireloom.llm.shared import folder


def rows():
    long = "<p>" + "long text " * 40000
    return [
        (5, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (9, None, "x" * 100), (3, "http://a/3", "x" * 99), (4, "http://a/4", "x" * 99),
        (6, "http://a/\r\nX: y", None), (7, "u", ""), (8, "u", "é" * 50), (10, "u", "é" * 50), (11, "u", long), (12, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (1, "u", long),
    ]


def full(df):
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.where("last").collect()]


def want(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = min(k for k, _, h in rows if (h or "") == (html or "")) if len(data) >= 100 else i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if same == i else "revisit", None if same == i else same))
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 1000, 7])
def test_archives_come_back(spark, chunk):
    some = [r for r in rows() if chunk > 7 or len(r[2] or "") < 1000]
    pages = spark.createDataFrame([(*r, "extra") for r in some], "page_id long, url string, html string, record_type string").repartition(3)
    at = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write(pages, at, chunk)
    found = warc.read(manifest, at, chunk).cache()
    assert sorted(full(found)) == sorted(want(some))
    payloads = {}
    for r in sorted(found.collect(), key=lambda r: (r.page_id, r.chunk_no)):
        payloads[r.page_id] = payloads.get(r.page_id, b"") + bytes(r.data)
        assert len(r.data) <= chunk
        if r.record_type == "response":
            assert (len(payloads[r.page_id]), hashlib.sha256(payloads[r.page_id]).hexdigest()) == (r.payload_bytes, r.payload_digest)
    for i, _, html in some:
        kind = next(x[3] for x in want(some) if x[0] == i)
        assert payloads[i] == ((html or "").encode() if kind == "response" else b"")


def test_archives_are_gzipped_warc(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1)
    at = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    name = warc.write(pages, at).first().file
    raw = gzip.decompress(warc.opened(at)[0].open_input_file(f"{warc.opened(at)[1]}/{name}").read())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and b"X: y\r\n" not in raw.replace(b"%0D%0AX: y\r\n", b"")


def test_nulls_repeats_and_nothing(spark):
    html = "y" * 200
    pages = spark.createDataFrame([(None, "u", html), (3, "u", html), (3, "u", html), (4, "u", html), (None, "u", "z" * 200), (None, "u", "z" * 200)], "page_id long, url string, html string")
    at = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    found = sorted(((r[0], r[3], r[4]) for r in full(warc.read(warc.write(pages, at), at))), key=str)
    assert found == [(3, "response", None), (3, "response", None), (4, "revisit", 3), (None, "response", None), (None, "response", None), (None, "revisit", 3)]
    assert full(warc.read(warc.write(pages.limit(0), f"{at}-none"), f"{at}-none")) == []


def test_changed_payload_is_found(spark):
    class Source:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    data = warc.head(1, "u", hashlib.sha256(b"abc").hexdigest(), 3, None, warc.DATE) + b"abd\r\n\r\n"
    packed = gzip.compress(data)
    with pytest.raises(ValueError):
        list(warc.records(warc.Stream(Source(packed), len(packed)), 2))


def test_sql(spark):
    pages = pd.DataFrame(rows(), columns=["page_id", "url", "html"])  # noqa: F841
    found = duckdb.sql(warc.SQL).fetchall()
    assert sorted((i, n, d, k, None if pd.isna(r) else r) for i, n, d, k, r in found) == sorted(want(rows()))
