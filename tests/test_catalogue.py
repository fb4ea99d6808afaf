"""Every registered query next to its SQL, on the smallest data."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tidemark.plans import ORACLES, QUERIES
from tools.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = queries()[name](spark, FOLDER)
    cursor = db.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, cursor.fetchall())
    assert got == want
    assert got


def test_entry(spark):
    assert entry(spark).count() > 0
