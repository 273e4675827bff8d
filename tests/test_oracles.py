"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from driftloom.plans import registry

DATA = "/root/testdata/sf0.001"
registry.load()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "None"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return plain(value.item()) if hasattr(value, "item") else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    frame = registry.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    oracle = duck.sql(registry.ORACLES[name])
    assert columns == sorted(oracle.columns)
    at = [oracle.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in oracle.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {r.family for r in __spark_entry__.entry(spark).collect()} == {"evidence", "schema", "stochastic", "prompt", "model"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
