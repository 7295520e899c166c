import os

import duckdb
import pytest

from factgate.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf)):
        con.sql(f"CREATE VIEW {file.partition('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
