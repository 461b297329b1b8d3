"""Every registered query against its check SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from tillcast.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
DUCKDB_TYPES = {
    "string": "VARCHAR",
    "double": "DOUBLE",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "date": "DATE",
    "boolean": "BOOLEAN",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return found


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return str(float(value)) if number else str(value)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("key", sorted(driver.oracle_sql()))
def test_matches_check_sql(spark, connection, key):
    df = driver.queries()[key](spark, FOLDER)
    found = canonical([tuple(r) for r in df.collect()], df.columns)
    result = connection.execute(driver.oracle_sql()[key])
    columns = {d[0]: str(d[1]) for d in result.description}
    assert {c: DUCKDB_TYPES[t] for c, t in df.dtypes} == columns
    assert found == canonical(result.fetchall(), list(columns))


def test_every_query_has_check_sql():
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
