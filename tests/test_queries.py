"""The queries over the driver's tables against their SQL, and the entry."""
import os

import duckdb
import pytest

from tellstone import queries

DIR = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float) and x == int(x):
        return int(x)
    return x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for file in os.listdir(DIR):
        c.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, con, name):
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda r: sorted(repr([plain(x) for x in t]) for t in r)
    assert rows(got.select(*[f"`{c}`" for c in want.columns]).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"simulated_match"}))
def test_others_run(spark, name):
    assert queries.queries()[name](spark, DIR).schema.names


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
