"""Every query with SQL against DuckDB, the others for rows."""

import duckdb
import pytest

from kelpie.plans import catalogue, catalogue_build  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    rows = [r.asDict() for r in catalogue.QUERIES[name](spark, SF).collect()]
    assert rows
    if name in catalogue.ORACLES:
        want = con.execute(catalogue.ORACLES[name]).to_arrow_table().to_pylist()
        key = lambda r: tuple((k, norm(v)) for k, v in sorted(r.items()))
        got, want = sorted(map(key, rows)), sorted(map(key, want))
        assert len(got) == len(want)
        assert got == want, next((a, b) for a, b in zip(got, want) if a != b)
