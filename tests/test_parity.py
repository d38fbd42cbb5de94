"""Registered queries against their SQL counterparts on the smallest star tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from verification.star_queries import registry
from verification.star_sql import counterparts

DIRECTORY = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
SPARK_TO_SQL = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="star tables are absent")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    yield connection
    connection.close()


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def clean(value):
        return None if isinstance(value, float) and math.isnan(value) else value

    cleaned = [tuple(clean(row[i]) for i in order) for row in rows]
    return sorted(cleaned, key=lambda row: [(value is not None, value) for value in row])


def test_every_star_query_has_sql():
    assert set(registry()) - set(counterparts()) == set()
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(registry()))
def test_query_equals_sql(spark, database, name):
    df = QUERIES[name](spark, DIRECTORY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    rows = [tuple(row) for row in df.collect()]
    if name not in SQL:
        assert rows
        return
    result = database.execute(SQL[name])
    names = [column[0] for column in result.description]
    types = {column[0]: str(column[1]) for column in result.description}
    assert sorted(df.columns) == sorted(names)
    assert {column: SPARK_TO_SQL[kind] for column, kind in df.dtypes} == types
    assert _sorted(df.columns, rows) == _sorted(names, result.fetchall())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 18
