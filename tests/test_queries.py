"""Every query against its SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from trailmark.plans import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
RUNS, SQL = load()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, duck, name):
    df = RUNS[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in places) for row in cursor.fetchall())


def test_every_query_has_sql():
    assert set(RUNS) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
