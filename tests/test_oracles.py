"""Every query with SQL, beside DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from braidstone.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = con.execute(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda f: f[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want))
