"""From features and coefficients to evaluations and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import text, vectors


def decision(x: Column, coef: Column, intercept: Column) -> Column:
    return vectors.dot(x, coef) + intercept


def evaluation(z: Column) -> Column:
    return F.when(z > 0, fixed.EVALUATION_GOOD).otherwise(fixed.EVALUATION_BAD)


def confidence(z: Column) -> Column:
    """Probability of the evaluation given, so never below one half."""
    p = vectors.logistic(z)
    return F.when(z > 0, p).otherwise(1 - p)


def score(rows: DataFrame) -> DataFrame:
    """Adds evaluation and score from (x, coef, intercept).

    A model whose width does not fit the features cannot score them: those
    rows get nulls instead of a number from misaligned columns.
    """
    fits = F.size("x") == F.size("coef")
    z = decision(F.col("x"), F.col("coef"), F.col("intercept"))
    scored = rows.withColumn("_z", F.when(fits, z))
    return scored.select(
        *rows.columns,
        F.when(F.col("_z").isNotNull(), evaluation(F.col("_z"))).alias("evaluation"),
        F.when(F.col("_z").isNotNull(), confidence(F.col("_z"))).alias("score"),
    )


def with_speech_acts(rows: DataFrame, column: str = "text") -> DataFrame:
    return rows.withColumn("metacognitive", text.metacognitive(F.col(column))).withColumn(
        "profanity", text.profanity(F.col(column))
    )
