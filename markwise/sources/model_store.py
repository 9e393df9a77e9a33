"""Tables keyed by (arch, lesson): models, configs, embeddings, ground truths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise import fixed_values as fixed

KEYS = ["arch", "lesson"]


def save(rows: DataFrame, path: str) -> None:
    """Replace exactly the (arch, lesson) partitions that ``rows`` holds.

    Rows are clustered by key and a salt, so a lesson's files stay few and a
    large lesson is still written by several tasks.
    """
    rest = [F.to_json(F.struct(c)) for c in rows.columns if c not in KEYS]
    salted = rows.repartition(*KEYS, F.pmod(F.xxhash64(*rest), F.lit(4)))
    salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, arch string, lesson string").parquet(path)


def presence(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested (arch, lesson) rows with whether a model is stored."""
    present = stored.select(*KEYS).distinct().withColumn("trained", F.lit(True))
    return requested.join(present, KEYS, "left").withColumn("trained", F.coalesce("trained", F.lit(False)))


def without(stored: DataFrame, removed: DataFrame) -> DataFrame:
    """The store's rows with the named (arch, lesson) models taken out."""
    return stored.join(removed.select(*KEYS).distinct(), KEYS, "left_anti")


def write_back(current: DataFrame, trained: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``trained`` replace those of ``current`` with the same keys.

    The pooled default model has no lesson to be written back to.
    """
    if "lesson" in trained.columns:
        trained = trained.filter(F.col("lesson") != fixed.DEFAULT_LESSON)
    kept = current.join(trained.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(trained, allowMissingColumns=True)
