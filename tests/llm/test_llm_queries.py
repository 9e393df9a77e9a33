"""The operators' queries next to their SQL."""

import duckdb
import pytest

from check import TABLES, normal
from markwise.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = normal(QUERIES[name](spark, SF).toPandas()), normal(duck.sql(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for column in got:
        assert got[column].astype(str).equals(want[column].astype(str)) or got[column].isna().all(), column


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
