"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from kelpie.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len({r["status"] for r in got}) > 1 if name == "op6_warc" else True
