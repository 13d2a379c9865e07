"""Every query against its SQL twin, compared as unordered rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def duck(data_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(data_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


# Queries that may find nothing on the smallest tables.
EMPTY: set[str] = set()


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(row[i]) for i in order) for row in rows], key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(name, spark, duck, data_dir):
    df = contract.queries()[name](spark, data_dir)
    actual = [tuple(r) for r in df.collect()]
    result = duck.execute(contract.oracle_sql()[name])
    expected_columns = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(expected_columns)
    assert len(actual) == len(expected)
    assert expected or name in EMPTY, "a query that finds nothing proves nothing"
    assert rows_of(df.columns, actual) == rows_of(expected_columns, expected)


def test_every_query_has_sql():
    from sheetspark.plans import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
