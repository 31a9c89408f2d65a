"""The training-data queries that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

from quillstone.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    mine = sorted((tuple(r[c] for c in order) for r in got.collect()), key=str)
    theirs = sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=str)
    assert mine == theirs
