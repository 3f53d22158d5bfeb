"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from lucidtext.plans import queries as engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def shown(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = engine.queries()[name](spark, DATA)
    names = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(engine.oracle_sql()[name])
    assert sorted(rel.columns) == names
    theirs = sorted(tuple(shown(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
    assert mine == theirs
