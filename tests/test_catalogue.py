"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from concord.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF)
    theirs = duck.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols
    shown = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert shown(ours.select(cols).collect()) == shown(theirs.select(*cols).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
