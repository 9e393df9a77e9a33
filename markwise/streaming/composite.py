"""A grader's results where they come in time, else the regression's, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators import grader
from markwise.operators.lookup import salted_join

RESULTS = "array<struct<exp_num: string, evaluation: string, score: double>>"


def masks_by_lesson(masks: DataFrame) -> DataFrame:
    """(lesson, exp_of): the expectation behind each concept a grader is shown."""
    pairs = F.collect_list(F.struct("concept", "exp_num"))
    return masks.groupBy("lesson").agg(F.map_from_entries(pairs).alias("exp_of"))


def graded_results(responses: DataFrame, masks: DataFrame) -> DataFrame:
    """(answer_id, came, graded) of the valid responses; concepts of no expectation drop out.

    ``responses``: (answer_id, lesson, came, response, n_concepts), a stream or a table.
    Each row is shaped by itself, so a stream needs no state for it.
    """
    # the condition names the time, so that it stays above the watermark: all responses move that on
    is_valid = F.col("came") >= F.when(F.col("valid"), F.lit("0001-01-01").cast("timestamp"))
    parsed = grader.parse_responses(responses).filter(is_valid)
    known = salted_join(parsed, masks_by_lesson(masks), ["lesson"], "answer_id", "inner")
    evaluation = f"IF(lower(e.value.is_known) = 'true', '{fixed.EVALUATION_GOOD}', '{fixed.EVALUATION_BAD}')"
    graded = (
        "transform(filter(map_entries(answer.concepts), e -> exp_of[e.key] IS NOT NULL), e -> named_struct("
        f"'exp_num', exp_of[e.key], 'evaluation', {evaluation}, 'score', e.value.confidence))"
    )
    return known.select("answer_id", "came", F.expr(graded).cast(RESULTS).alias("graded"))


def regression_results(scores: DataFrame, asked: DataFrame) -> DataFrame:
    """(answer_id, asked, regression): an answer's scores in one row, as a stream of answers carries them.

    ``asked``: (answer_id, asked), the time of each answer.
    """
    rows = F.collect_list(F.struct("exp_num", "evaluation", "score"))
    nested = scores.groupBy("answer_id").agg(F.array_sort(rows).cast(RESULTS).alias("regression"))
    return asked.join(nested, "answer_id")


def composite_stream(
    answers: DataFrame, responses: DataFrame, masks: DataFrame, limit: str = fixed.GRADER_LIMIT, late: str = "1 minute"
) -> DataFrame:
    """(answer_id, asked, source, results): one row per answer, of two streams.

    ``answers``: (answer_id, asked, regression); ``responses``: (answer_id, lesson,
    came, response, n_concepts); ``masks``: a table. Responses that are not valid
    count as none, but their times move the watermark on.
    An answer waits for its grader until ``limit`` after it was asked. If a
    result came by then, all its results are the grader's. If not, the answer falls
    out of the join with its regression when the watermark has passed. A
    response that is sent twice counts once, the first that arrives (any of those
    that arrive in one micro-batch). Both sides
    are kept for ``limit`` and ``late`` at most, so state does not grow with the
    stream; results of answers nobody asked are dropped with the watermark.
    """
    given = (
        graded_results(responses.withWatermark("came", late), masks)
        .dropDuplicatesWithinWatermark(["answer_id"])
        .select(F.col("answer_id").alias("_answer"), "came", "graded")
    )
    in_time = f"answer_id = _answer AND came >= asked AND came <= asked + INTERVAL {limit}"
    joined = answers.withWatermark("asked", late).join(given, F.expr(in_time), "leftOuter")
    source = F.when(F.col("_answer").isNotNull(), "grader").otherwise("regression")
    return joined.select(
        "answer_id", "asked", source.alias("source"), F.coalesce("graded", "regression").alias("results")
    )
