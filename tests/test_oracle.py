"""Every query with a SQL twin, compared with it on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, compare

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def connection():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    rows, problems = compare(entry.queries()[name](spark, FOLDER), connection, entry.oracle_sql()[name])
    assert not problems and rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["model", "rmse", "mbe", "rsq", "n"]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
