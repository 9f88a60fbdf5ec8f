"""All queries of the engine against SQL on the small tables, where those are there."""

import math
import os

import pytest

import __spark_entry__ as entry
from lorespark import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return round(float(value), 5) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def compare(spark, duck, query, text):
    df = query(spark, DATA)
    result = duck.execute(text)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in result.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in sorted(names)) for row in df.collect()), key=repr)
    assert got == want


@needs_data
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, registry.QUERIES[name], registry.SQL[name])


@needs_data
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
