"""Test-set accuracy, training summaries, replicated data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import vectors
from markwise.operators import logistic, scoring
from markwise.operators.skew import salted_join
from markwise.session import written


def effective_label(evaluation: Column, score: Column, threshold: Column) -> Column:
    """Below the threshold of confidence the evaluation counts as neutral."""
    return F.when(score < threshold, fixed.NEUTRAL).otherwise(F.lower(evaluation))


def failures(results: DataFrame) -> DataFrame:
    """Marks the (expected, observed) rows that fail.

    Columns: comparison (GTE, LT or EQ), threshold, label, evaluation, score
    and optionally epsilon. A row fails on a missed bound or on a wrong
    evaluation; only a met LT bound turns the observed evaluation neutral.
    """
    score, bound = F.col("score"), F.col("threshold")
    epsilon = F.col("epsilon") if "epsilon" in results.columns else F.lit(0.01)
    met = (
        F.when(F.col("comparison") == "GTE", score >= bound)
        .when(F.col("comparison") == "LT", score < bound)
        .otherwise(F.abs(score - bound) <= epsilon)
    )
    observed = F.when((F.col("comparison") == "LT") & met, F.lit(fixed.NEUTRAL)).otherwise(F.lower("evaluation"))
    wrong = (F.length("label") > 0) & (observed != F.lower("label"))
    return results.withColumn("failed", F.when(met & ~wrong, 0).otherwise(1))


def match_expected(predictions: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.join(expected, keys)


def accuracy(results: DataFrame, by: list[str]) -> DataFrame:
    """(by…, n_expectations, accuracy); a key without results has accuracy 0."""
    checked = failures(results)
    n, bad = F.count("failed"), F.sum("failed")
    return checked.groupBy(*by).agg(
        n.alias("n_expectations"), F.when(n > 0, 1 - bad / n).otherwise(F.lit(0.0)).alias("accuracy")
    )


def training_summary(models: DataFrame) -> DataFrame:
    """(lesson, n_expectations, expectations, mean_accuracy, models)."""
    entry = F.struct("exp_num", "accuracy")
    return models.groupBy("arch", "lesson").agg(
        F.count(F.lit(1)).alias("n_expectations"),
        F.array_sort(F.collect_list(entry)).alias("expectations"),
        F.avg("accuracy").alias("mean_accuracy"),
    ).withColumn("models", F.concat_ws("/", "arch", "lesson"))


def replicate(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, told apart by ``copy``; no join, no shuffle."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def replication_experiment(features: DataFrame, keys: list[str], factors: list[int]) -> DataFrame:
    """(keys…, factor, n_rows, accuracy, confidence, loss) of models trained on every row ``factor`` times.

    ``n_rows`` counts the copies. The three are means over the rows, each weighed once: how often the
    model is right, how sure it is of what it says, and the balanced log loss, which cannot rise with the factor.
    """
    fits = written(logistic.replicated_fits(features, keys, factors), "fits")
    together = fits.groupBy(*keys).agg(F.collect_list(F.struct("factor", "coef", "intercept")).alias("fits"))
    counts = logistic.class_counts(features, keys).withColumnRenamed("n_rows", "n")
    rows = salted_join(features, together.join(counts, keys), keys, "row_id", "inner")
    each = rows.select(*keys, "n", "n_good", "y", "x", F.explode("fits").alias("f"))
    z = scoring.decision(F.col("x"), F.col("f.coef"), F.col("f.intercept"))
    each = each.select(*keys, F.col("f.factor").alias("factor"), "n", "n_good", "y", z.alias("z"))
    weight = F.col("n") / (2 * F.when(F.col("y") == 1, F.col("n_good")).otherwise(F.col("n") - F.col("n_good")))
    margin = F.when(F.col("y") == 1, F.col("z")).otherwise(-F.col("z"))
    lost = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    return each.groupBy(*keys, "factor").agg(
        (F.count(F.lit(1)) * F.first("factor")).alias("n_rows"),
        F.avg(((F.col("z") > 0) == (F.col("y") == 1)).cast("double")).alias("accuracy"),
        F.avg(vectors.logistic(F.abs("z"))).alias("confidence"),
        F.avg(weight * lost).alias("loss"),
    )
