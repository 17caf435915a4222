"""The operators' queries over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wireloom.llm import ann, bpe, html_text, lm_score, packing, quality, simhash, toxicity, url_filter, warc
from wireloom.shipping import shipped

_QUERIES = {
    "op1_warc": warc.query,
    "op2_toxicity": toxicity.query,
    "op3_html_text": html_text.query,
    "op4_url_filter": url_filter.query,
    "op5_ann": ann.query,
    "op6_bpe": bpe.query,
    "op7_quality": quality.query,
    "op8_lm_score": lm_score.query,
    "op9_packing": packing.query,
    "op10_simhash": simhash.query,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: shipped(f) for name, f in _QUERIES.items()}

SQL: dict[str, str] = {"op1_warc": warc.SQL, "op4_url_filter": url_filter.SQL}
