"""The kinds of classifier by name, each a pair of job builders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators import grader, scoring
from markwise.plans import evaluate as regression
from markwise.plans import training


@dataclass(frozen=True)
class Architecture:
    train: Callable[..., object]
    evaluate: Callable[..., DataFrame]


def train_truth(training_rows: DataFrame, expectations: DataFrame) -> DataFrame:
    return grader.ground_truth(training_rows, expectations)


def evaluate_responses(answers: DataFrame, expectations: DataFrame, responses: DataFrame) -> DataFrame:
    """Results of the grader's responses, with the answers' speech acts.

    ``responses``: (answer_id, lesson, response). Answers without a valid
    response have no rows here.
    """
    masks = grader.concept_masks(expectations)
    sizes = masks.groupBy("lesson").agg(F.count(F.lit(1)).cast("int").alias("n_concepts"))
    parsed = grader.parse_responses(grader.salted_join(responses, sizes, ["lesson"], "answer_id", "inner"))
    results = grader.grader_results(parsed, masks).join(answers.select("answer_id", "text"), "answer_id")
    return scoring.with_speech_acts(results).drop("text")


def evaluate_both(
    answers: DataFrame, configs: DataFrame, models: DataFrame, vocabulary: DataFrame, responses: DataFrame
) -> DataFrame:
    """The grader's results per answer where it succeeded, else the regression's."""
    graded = evaluate_responses(answers, configs, responses)
    scored = regression.evaluate(answers, configs, models, vocabulary)
    best = grader.prefer_grader(graded, scored).join(answers.select("answer_id", "text"), "answer_id")
    return scoring.with_speech_acts(best).drop("text")


def train_both(training_rows: DataFrame, expectations: DataFrame, vocabulary: DataFrame, options=None):
    return training.train(training_rows, expectations, vocabulary, options), train_truth(training_rows, expectations)


ARCHITECTURES: dict[str, Architecture] = {
    fixed.ARCH_REGRESSION: Architecture(training.train, regression.evaluate),
    fixed.ARCH_LANGUAGE_MODEL: Architecture(train_truth, evaluate_responses),
    fixed.ARCH_COMPOSITE: Architecture(train_both, evaluate_both),
}


def register(name: str, architecture: Architecture) -> None:
    if name in ARCHITECTURES:
        raise ValueError(f"architecture {name} is registered already")
    ARCHITECTURES[name] = architecture
