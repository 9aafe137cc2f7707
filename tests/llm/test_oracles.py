"""Registered queries and their SQL on the smallest tables; the pipeline's stages on all that they are given."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from spindrift.llm import registry

from ..test_catalogue import FOLDER, TABLES, rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = registry.queries()[name](spark, FOLDER).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_names():
    assert sorted(registry.queries()) == sorted(f"op{k}_{n}" for k, n in ((1, "secrets"), (2, "decontamination"), (3, "simhash"), (4, "warc"), (5, "quality_rules"), (6, "bpe"), (7, "urls"), (8, "substrings"), (9, "maxent"), (10, "sharding")))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER).cache()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        docs = out
    assert docs.count() == corpus_pipeline.run(spark, FOLDER).count() > 100
