"""Joins and ranks that hold up when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwise.session import written

SALTS = 8


def salted_join(
    many: DataFrame,
    few: DataFrame,
    on: list[str],
    spread: str | list[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``many`` rows per key to ``few``, splitting each key over salts.

    ``spread`` names columns of ``many`` that differ within a key. ``few`` is
    repeated once per salt, so a key with a third of all rows still spreads
    over ``salts`` tasks. Only joins that keep the left side fit (inner, left,
    left_semi, left_anti). Where ``few`` is small enough by its statistics
    Catalyst broadcasts it and nothing is shuffled.
    """
    columns = [spread] if isinstance(spread, str) else spread
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
    repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def rank_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """0-based rank of every row within ``keys`` by ``order``, for any group size.

    The rows are range-partitioned by (keys, order) and written, so each slice
    is a contiguous run; ranks are counted inside (keys, slice) and shifted by
    the sizes of the slices before. No task ever holds a whole group.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = written(
        df.repartitionByRange(partitions, *keys, *order).withColumn("_slice", F.spark_partition_id()), "rank"
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    before = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    return (
        sliced.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(shifts, [*keys, "_slice"])
        .withColumn(name, F.col("_inside") + F.col("_shift"))
        .drop("_inside", "_shift", "_slice")
    )
