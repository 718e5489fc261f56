"""The queries over the smallest tables against their SQL."""
import os

import duckdb
import pytest

from tellstone.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
