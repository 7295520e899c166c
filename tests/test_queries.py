import os

import duckdb
import pandas as pd
import pytest

from factgate.workload import load_all

QUERIES, SQL = load_all()


@pytest.fixture(scope="session")
def engine(sf):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        con.sql(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def rows(columns, data):
    df = pd.DataFrame(data, columns=columns, dtype=object)[sorted(columns)]
    text = lambda v: "null" if v is None or v is pd.NaT or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, engine, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        want = engine.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())


def test_entry_point_lists_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
