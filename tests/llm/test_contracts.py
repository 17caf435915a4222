"""The queries' columns and types, and their rows on the smallest tables."""

import hashlib
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.llm.test_classifiers import plain_counts
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2_toxicity": "doc_id bigint, toxic boolean",
    "op3_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op4_url_filter": "page_id bigint, url string, blocked boolean",
    "op5_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_lm_score": "doc_id bigint, n_tokens bigint, score double",
    "op9_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
}


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def test_one_query_each():
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    df = entry.queries()[name](spark, SF)
    assert {tuple(c.split()) for c in COLUMNS[name].split(", ")} <= set(df.dtypes)
    key = df.columns[0]
    table = {"page_id": "pages", "doc_id": "documents"}.get(key)
    if table and name != "op9_packing":
        assert sorted(r[0] for r in df.select(key).collect()) == sorted(pd.read_parquet(f"{SF}/{table}.parquet")[key])


def test_fingerprints_and_components(spark, documents):
    rows = [(i, plain_fingerprint(t)) for i, t in zip(documents.doc_id, documents.text)]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(rows, plain_components(rows))}
    assert {tuple(r) for r in entry.queries()["op10_simhash"](spark, SF).collect()} == want


def test_base_rules(spark, documents):
    texts = dict(zip(documents.doc_id, documents.text))
    for r in entry.queries()["op7_quality"](spark, SF).collect():
        if len(texts[r.doc_id]) < 6000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_decoded_bytes(spark, documents):
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(documents.doc_id, documents.text)}
    assert {r.doc_id: r.decoded_sha256 for r in entry.queries()["op6_bpe"](spark, SF).collect()} == want


def test_scores_are_finite(spark):
    assert all(math.isfinite(r.score) for r in entry.queries()["op8_lm_score"](spark, SF).collect() if r.n_tokens)


@pytest.mark.parametrize("name", ["op1_warc", "op4_url_filter"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(got.fetchall(), key=str)
