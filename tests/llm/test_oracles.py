"""Queries that have SQL against it on the smallest tables."""

import duckdb
import pytest

from quirework.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str) == sorted(want.select(*(f'"{c}"' for c in sorted(want.columns))).fetchall(), key=str)
