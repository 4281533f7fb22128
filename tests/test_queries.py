"""Every query with SQL gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

# The queries of the other subpackage have tests of their own.
from tripleforge.plans import registry


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) or hasattr(v, "quantize"):
        return "nan" if v != v else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["pair_id", "wl"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
