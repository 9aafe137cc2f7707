"""Every operator on empty tables, nulls, repeated rows and clashing columns: defined results, a row for each row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spindrift.llm import near, op1_secrets, op2_decontamination, op3_simhash, op4_warc, op5_quality, op6_bpe, op7_urls, op8_substrings, op9_maxent, op10_sharding

from .helpers import SCHEMA, odd_documents


def operators(spark):
    bench = spark.createDataFrame([(1, None), (None, "two words"), (3, "")], "item_id long, text string")
    return {
        "op1": op1_secrets.findings,
        "op2": lambda d: op2_decontamination.contamination(d, bench),
        "op3": op3_simhash.components,
        "op3n": near.near_components,
        "op5": op5_quality.quality,
        "op6": op6_bpe.digests,
        "op8": op8_substrings.dedup,
        "op9": op9_maxent.score,
        "op10": op10_sharding.assign,
    }


NAMES = ["op1", "op2", "op3", "op3n", "op5", "op6", "op8", "op9", "op10"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(odd_documents([(6, "word " * 3000)]), SCHEMA)
    got = operators(spark)[name](docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    same = [r for r in got if r.doc_id == 4]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_odd_pages(spark):
    rows = [(1, None, None, 7), (2, "x", "", 7), (3, "http://h.net/es/1", "<a>", 7), (3, "http://h.net/es/1", "<a>", 7), (None, "://", "<a>", 7), (4, "http://é.com\r\n/", "<a>", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long")
    got = op4_warc.round_trip(pages).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(0, 3, "response", None), (1, 0, "revisit", 2), (2, 0, "response", None), (3, 3, "revisit", 4), (3, 3, "revisit", 4), (4, 3, "response", None)]
    assert op4_warc.round_trip(pages.limit(0)).count() == 0
    got = {(r.page_id, r.host, r.path, r.rule) for r in op7_urls.verdicts(pages).collect()}
    assert got == {(1, "", "", None), (2, "", "", None), (3, "h.net", "/es/1", "net/es/"), (None, "", "", None), (4, "é.com\r\n", "/", "com/")} or got == {(1, "", "", None), (2, "", "", None), (3, "h.net", "/es/1", "net/es/"), (None, "", "", None), (4, "é.com\r\n", "/", None)}
    assert {r.verdict for r in op7_urls.verdicts(pages.filter("page_id < 3")).collect()} == {"allow"}
    assert op7_urls.verdicts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [op5_quality.clean, near.representatives, op1_secrets.redact])
def test_stages_keep_columns(spark, stage):
    docs = spark.createDataFrame(odd_documents([(7, "password=abcdefgh12 " + " ".join(f"w{i}" for i in range(80)))]), SCHEMA)
    got = stage(docs)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert got.filter(F.col("doc_id") == 7).count() == 1
    assert stage(docs.limit(0)).count() == 0


def test_texts_without_ids_stay(spark):
    """Each component keeps a row, also where no row has an id; blank texts are one component, repeated rows one row."""
    got = [(r.doc_id, r.text) for r in near.representatives(spark.createDataFrame(odd_documents(), SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (None, "a null id has a text of its own"), (4, "same row"), (5, "é😀 \u3000 ß")], key=str)
