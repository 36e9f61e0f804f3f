"""Every registered query of the library against its SQL on the smallest tables (SF_DIR chooses others)."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry_point
from talusgrid.plans.oracle import all_sql
from talusgrid.plans.registry import all_queries

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_registers_them():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, con.execute(SQL[name]).fetchdf()) is None


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() == 24
