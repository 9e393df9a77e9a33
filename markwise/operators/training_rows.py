"""Which rows each expectation is trained on, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import text
from markwise.operators.skew import salted_join
from markwise.session import written

KEYS = ["lesson", "exp_num"]


def trainable(training: DataFrame, expectations: DataFrame, developer_mode: bool = False) -> DataFrame:
    """Expectations with enough graded rows, counted before any clean-up."""
    if developer_mode:
        return expectations.select(*KEYS).distinct()
    counts = training.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
    enough = counts.filter(F.col("n_rows") >= fixed.MIN_GRADED_ROWS)
    return expectations.select(*KEYS).distinct().join(enough.select(*KEYS), KEYS, "left_semi")


def clean_rows(training: DataFrame) -> DataFrame:
    """Normalised text and label; only good/bad rows with a text remain."""
    return (
        training.withColumn("label", text.normalise_label(F.col("label")))
        .filter(F.col("label").isin(fixed.GOOD, fixed.BAD) & F.col("text").isNotNull())
        .withColumn("text", text.normalise_answer(F.col("text")))
    )


def ordered_rows(training: DataFrame, expectations: DataFrame, keep: DataFrame) -> DataFrame:
    """(lesson, exp_num, place, row_id, text, label): ideals first, then graded rows.

    ``place`` is 0 for the ideal answer, 1 for graded rows and 2 for the
    appended answer that names every concept, so (place, row_id) is the
    training order.
    """
    keep = keep.select(*KEYS)
    graded = salted_join(training, keep, KEYS, "row_id", "left_semi")
    ideals = (
        expectations.filter(F.length("ideal") > 0)
        .join(keep, KEYS, "left_semi")
        .select(*KEYS, F.lit(0).alias("place"), F.lit(-1).cast("bigint").alias("row_id"),
                F.col("ideal").alias("text"), F.lit(fixed.GOOD).alias("label"))
    )
    rows = ideals.unionByName(
        graded.select(*KEYS, F.lit(1).alias("place"), F.col("row_id").cast("bigint"), "text", "label")
    )
    return clean_rows(rows)


def all_concepts_answer(rows: DataFrame, expectations: DataFrame) -> DataFrame:
    """(lesson, text): the lesson's ideals (else first texts) run together."""
    return _concepts(first_texts(rows), expectations)


def first_texts(rows: DataFrame) -> DataFrame:
    """(lesson, exp_num, first_text) of every trained expectation."""
    return rows.groupBy(*KEYS).agg(F.min_by("text", F.struct("place", "row_id")).alias("first_text"))


def _concepts(firsts: DataFrame, expectations: DataFrame) -> DataFrame:
    parts = firsts.join(expectations.select(*KEYS, "ideal"), KEYS, "left").select(
        *KEYS, F.coalesce(F.when(F.length("ideal") > 0, F.col("ideal")), "first_text").alias("part")
    )
    ordered = F.array_sort(F.collect_list(F.struct("exp_num", "part")))
    return parts.groupBy("lesson").agg(ordered.alias("parts")).select(
        "lesson", F.array_join(F.col("parts.part"), "").alias("text")
    )


def with_all_concepts(rows: DataFrame, expectations: DataFrame) -> DataFrame:
    """Append the all-concepts answer to every trained expectation, raw case.

    The rows' first texts are written, so what the rows are made of is not
    planned anew for each of the answer's parts.
    """
    firsts = written(first_texts(rows), "firsts")
    extra = (
        firsts.select(*KEYS)
        .join(_concepts(firsts, expectations), "lesson")
        .select(*KEYS, F.lit(2).alias("place"), F.lit(-1).cast("bigint").alias("row_id"), "text",
                F.lit(fixed.GOOD).alias("label"))
    )
    return rows.unionByName(extra)


def encode_label(label: Column) -> Column:
    return F.when(label == fixed.GOOD, 1).otherwise(0)


def reference_tokens(rows: DataFrame) -> DataFrame:
    """(lesson, exp_num, ideal_tokens): tokens of each group's first row."""
    return first_texts(rows).select(*KEYS, text.preprocess("first_text").alias("ideal_tokens"))
