"""Helpers work on slices of batches; the rows and their order stay."""

from pyspark.sql import types as T

from markwise.llm import batches


def test_helpers_see_few_rows_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(batches, "SLICE_ROWS", 100)
    made = T.StructType([T.StructField("seen", T.LongType()), T.StructField("upper", T.StringType())])

    def make():
        return lambda column: [[len(column)] * len(column), [t and t.upper() for t in column.to_pylist()]]

    rows = spark.range(950).repartition(1).selectExpr("id", "IF(id % 7 = 0, NULL, concat('t', id)) AS text")
    found = {r.id: r for r in batches.add_columns(rows, ["text"], made, make, ["id"]).collect()}
    assert sorted(found) == list(range(950)) and max(r.seen for r in found.values()) <= 100
    assert all(r.upper == (None if i % 7 == 0 else f"T{i}") for i, r in found.items())
