"""Every registered query against its SQL check, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import check

SF_DIR = "/root/testdata/sf0.001"
# Results that have no rows in the smallest tables, in both engines.
MAY_BE_EMPTY = {"nodes_not_ready", "set_difference"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", entry_points.queries())
def test_query_equals_its_sql(spark, db, name):
    build, sql = entry_points.queries()[name], entry_points.oracle_sql().get(name)
    verdict, detail, _ = check.compare(spark, db, name, build, sql, SF_DIR)
    assert verdict == ("rows only" if sql is None else "equal") or (verdict == "EMPTY" and name in MAY_BE_EMPTY), detail


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 6
