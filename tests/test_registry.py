"""Every registered movement and record query against its DuckDB statement on the smallest tables."""

import os

import duckdb
import pytest

from strideframe.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{float(value):.8g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in registry.ORACLES:
        assert got
        return
    assert got or name == "boundary_error"  # the smallest tables have no such neighbours
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(map(plain, r)) for r in want.select(*columns).fetchall())
