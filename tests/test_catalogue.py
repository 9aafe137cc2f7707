"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from spindrift.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    return round(float(x), 9) if isinstance(x, (int, float, np.integer, np.floating, np.bool_)) else str(x)


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    out = [tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalogue.queries()[name](spark, FOLDER).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
