"""Every registered query against its DuckDB oracle on the smallest test data."""

from __future__ import annotations

import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from holdfast.oracle import ORACLE
from holdfast.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["lineitem", "part"]

pytestmark = pytest.mark.skipif(not os.path.exists(SF_DIR), reason="test data not present")


def _norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return f"D{v}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_DIR)
    s_rows = df.collect()
    duck.execute(f"CREATE OR REPLACE VIEW oracle AS {ORACLE[key]}")  # as a caller may load it
    res = duck.execute("SELECT * FROM oracle")
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    order = sorted(df.columns)
    s = Counter(tuple(_norm(r[c]) for c in order) for r in s_rows)
    d = Counter(tuple(_norm(r[d_cols.index(c)]) for c in order) for r in d_rows)
    assert len(s_rows) == len(d_rows)
    assert s == d


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["timestamp", "symbol", "valuation"]
    assert df.count() > 0
