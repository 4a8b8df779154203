"""Every SQL-checked query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

SF = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    found = db.sql(CHECKS[name])
    assert sorted(frame.columns) == sorted(found.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(found.columns, found.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_its_query():
    assert set(CHECKS) <= set(entry.queries())
