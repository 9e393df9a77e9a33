"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import re

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, normal

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
# plans that train models; check.py compares them
HEAVY = {"train_quality_switch", "model_fit_optimality", "replication_experiment"}
LLM = {name for name in SQL if re.match(r"op\d+_", name)}  # tests/llm


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def compare(spark, duck, name):
    got, want = normal(queries()[name](spark, SF).toPandas()), normal(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for column in got:
        if got[column].isna().all() and want[column].isna().all():
            continue
        if got[column].dtype.kind == "f" or want[column].dtype.kind == "f":
            x, y = got[column].astype(float), want[column].astype(float)
            assert (x.isna() == y.isna()).all() and ((x - y).abs().fillna(0) < 2e-5).all(), column
        else:
            assert got[column].astype(str).equals(want[column].astype(str)), column


@pytest.mark.parametrize("name", sorted(set(SQL) - HEAVY - LLM))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, name)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(queries())
