"""Every query with SQL against DuckDB, on the smallest tables, and the promises of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quillframe.plans.driver import ORACLE, QUERIES, TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(frame.columns)
    rows = plain(frame.collect(), frame.columns, columns)
    assert rows and rows == plain(found.fetchall(), columns, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
