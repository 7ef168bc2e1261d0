import duckdb
import pytest

from claimloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in names]
    assert rows == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)
