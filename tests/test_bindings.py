"""Every bound query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from taproot.plans import bindings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, duck, name):
    df = bindings.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in bindings.ORACLE_SQL:
        names = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(duck.sql(f"SELECT {names} FROM ({bindings.ORACLE_SQL[name]})").fetchall(), key=repr)
    else:
        assert got
