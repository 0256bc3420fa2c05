"""Every registered query against its expected result in SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from astrolake.plans.queries import REGISTRY

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


def test_library_queries_have_expected_results():
    assert set(REGISTRY) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query(spark, db, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    result = db.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = [tuple(row) for row in result.fetchall()]
    got = [tuple(row) for row in df.select(*columns).collect()]
    assert ordered(got) == ordered(expected)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 40
