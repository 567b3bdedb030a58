"""Every registered query against its SQL twin, at the smallest scale."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from millrace.plans import abt
from millrace.sources.tables import TABLES

TWINS = oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, folder, con, name):
    ok, note = check.compare(spark, con, folder, name, queries()[name], TWINS.get(name))
    assert ok, note


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == abt.COLUMNS
    assert df.count() > 0
