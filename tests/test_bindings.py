"""Every bound query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from codelode.plans import bindings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "none"
    if isinstance(v, bool | str):
        return str(v)
    return str(round(float(v), 6))


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_against_sql(spark, sql, name):
    got = bindings.QUERIES[name](spark, SF)
    want = sql.sql(bindings.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    rows = sorted([plain(r[i]) for i in order] for r in want.fetchall())
    assert sorted([plain(r[c]) for c in sorted(got.columns)] for r in got.collect()) == rows
