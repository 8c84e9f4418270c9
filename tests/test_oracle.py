"""Every registered query against its DuckDB oracle on the smallest test data."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from gridbill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    missing = set(catalog.QUERIES) - set(catalog.ORACLE)
    assert not missing


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(E.oracle_sql()[name])
    want = _rows(cur.fetchall(), [d[0] for d in cur.description])
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["Month", "Electricity", "Water", "Gas", "TotalRevenue"]
