"""Every registered query against its SQL in DuckDB, over the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from swipewatch.plans import catalog, expected

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
QUERIES, SQL = catalog.QUERIES, expected.EXPECTED  # the corpus queries have tests of their own


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= entry_points.queries().keys() and SQL.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    found = sorted(repr(tuple(row[c] for c in columns)) for row in result.collect())
    answer = tables.sql(SQL[name])
    assert sorted(answer.columns) == columns
    order = [answer.columns.index(c) for c in columns]
    assert sorted(repr(tuple(row[i] for i in order)) for row in answer.fetchall()) == found
    types = dict(zip(answer.columns, map(str, answer.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in result.schema.fields} == types


def test_the_two_profiles_differ(spark):
    """The oracles of the two profiles can tell one from the other, and every field fails somewhere."""
    fields = [{name for r in QUERIES[query](spark, FOLDER).select("fields").distinct().collect() for name in r.fields.split(",") if name}
              for query in ("validate_stream", "validate_submit")]
    assert fields[1] - fields[0] == {"transaction_type", "latitude", "longitude"} and "amount" in fields[0] and "customer_id" in fields[0]
    assert SQL["validate_stream"] != SQL["validate_submit"]


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == entry_points.entry(spark).columns and result.count() == 1000
