"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from quern.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def test_all_have_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    done = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    wanted = sorted(([dict(zip(columns, r, strict=True))[c] for c in order] for r in done.fetchall()), key=repr)
    assert sorted(([r[c] for c in order] for r in df.collect()), key=repr) == wanted
