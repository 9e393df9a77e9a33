"""Scoring of answers with stored models and configs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import text
from markwise.functions.config_values import flag
from markwise.operators import assembly, lookup, scoring
from markwise.session import written

KEYS = ["lesson", "exp_num"]
LISTS = ["good", "bad", "archetype_good", "archetype_bad", "patterns_good", "patterns_bad"]
FLAGS = [
    fixed.FEATURE_LENGTH_RATIO,
    fixed.FEATURE_REGEX_AGGREGATE_DISABLED,
    fixed.FEATURE_ARCHETYPE_ENABLED,
    fixed.FEATURE_PATTERNS_ENABLED,
]


def scoring_settings(configs: DataFrame, asked: DataFrame, trained: DataFrame) -> DataFrame:
    """Settings of every (lesson, exp_num) asked for.

    Flags come from the stored config, not from job parameters. An expectation
    without its own model is scored by the default model, so its generated
    archetypes and patterns are left aside. Ids the config does not know have
    an empty ideal and no features, but still their lesson's question.
    """
    none = F.expr("CAST(array() AS array<string>)")
    own = trained.select(*KEYS).distinct().withColumn("_trained", F.lit(True))
    questions = configs.groupBy("lesson").agg(F.max("question").alias("_question"))
    rows = asked.select(*KEYS).distinct().join(lookup.first_configs(configs), KEYS, "left")
    rows = rows.join(questions, "lesson", "left").join(own, KEYS, "left")
    for name in LISTS:
        present = F.col(name) if name in configs.columns else none
        rows = rows.withColumn(name, F.coalesce(present, none))
    for name in FLAGS:
        present = F.col(name) if name in configs.columns else F.lit(False)
        rows = rows.withColumn(name, flag(present))
    generated = F.coalesce("_trained", F.lit(False))

    def used(switch: str, *names: str):
        return F.when(generated & F.col(switch), F.concat(*names)).otherwise(none)

    rows = rows.withColumn("_ideal", F.coalesce("ideal", F.lit(""))).withColumn("_asked", F.coalesce("_question", F.lit("")))
    return rows.select(
        *KEYS,
        text.preprocess("_ideal").alias("ideal_tokens"),
        text.preprocess("_asked").alias("question_tokens"),
        "good", "bad",
        used(fixed.FEATURE_ARCHETYPE_ENABLED, "archetype_good", "archetype_bad").alias("archetypes"),
        used(fixed.FEATURE_PATTERNS_ENABLED, "patterns_good", "patterns_bad").alias("patterns"),
        *FLAGS,
    )


@dataclass
class Store:
    """What a place holds of trained lessons."""

    configs: DataFrame
    models: DataFrame


def resolved_tables(
    answers: DataFrame, configs: DataFrame, local: Store, deployed: Store, default_models: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(configs, models) to score the answers' lessons with, a lesson from one place as a whole.

    A lesson with models in the local store is taken from there, else from the deployed one. A
    lesson that neither has models of keeps its plain config (``configs``), without
    anything generated, and is scored by the default model.
    """
    requested = answers.select("lesson").distinct()
    default = requested.sparkSession.range(1).select(F.lit("default").alias("place"))
    places = {name: store.models.filter(F.col("lesson") != fixed.DEFAULT_LESSON).select("lesson").distinct()
              .withColumn("place", F.lit(name)) for name, store in (("local", local), ("deployed", deployed))}
    origin = written(lookup.resolve_store(requested, places["local"], places["deployed"], default), "origin")

    def of(rows: DataFrame, place: str) -> DataFrame:
        return rows.join(origin.filter(F.col("place") == place).select("lesson"), "lesson", "left_semi")

    generated = [c for c in configs.columns if c in LISTS[2:] or c in FLAGS[2:]]
    own = [of(local.configs, "local"), of(deployed.configs, "deployed"), of(configs.drop(*generated), "default")]
    models = of(local.models, "local").unionByName(of(deployed.models, "deployed"), allowMissingColumns=True)
    models = models.unionByName(default_models.filter(F.col("lesson") == fixed.DEFAULT_LESSON), allowMissingColumns=True)
    return reduce(lambda a, c: a.unionByName(c, allowMissingColumns=True), own), models


def evaluate_resolved(
    answers: DataFrame, configs: DataFrame, local: Store, deployed: Store, default_models: DataFrame,
    vocabulary: DataFrame, lowercase: bool = False,
) -> DataFrame:
    """``evaluate`` with what ``resolved_tables`` finds for each lesson."""
    found, models = resolved_tables(answers, configs, local, deployed, default_models)
    return evaluate(answers, written(found, "configs"), written(models, "models"), vocabulary, lowercase)


def evaluate(
    answers: DataFrame, configs: DataFrame, models: DataFrame, vocabulary: DataFrame, lowercase: bool = False
) -> DataFrame:
    """(answer_id, lesson, exp_num, pos, evaluation, score, own_model,
    metacognitive, profanity) for every answer and expectation asked for.

    Every result has a score. What no model fits (a stored model whose width
    is not its config's, or neither an own nor a default model) is in
    ``unscored`` of the same arguments instead.

    Answers are scored in the case they were typed in, as training lowers only
    the training texts; ``lowercase=True`` evens that out.
    """
    rows = _modelled(answers, configs, models, vocabulary, lowercase)
    return rows.filter("score IS NOT NULL").select(
        "answer_id", *KEYS, "pos", "evaluation", "score", "own_model", "metacognitive", "profanity"
    )


def unscored(
    answers: DataFrame, configs: DataFrame, models: DataFrame, vocabulary: DataFrame, lowercase: bool = False
) -> DataFrame:
    """(answer_id, lesson, exp_num, own_model, n_features, n_coefficients) of
    what ``evaluate`` has to leave out."""
    rows = _modelled(answers, configs, models, vocabulary, lowercase).filter("score IS NULL")
    sizes = [F.size("x").alias("n_features"), F.when(F.col("coef").isNotNull(), F.size("coef")).alias("n_coefficients")]
    return rows.select("answer_id", *KEYS, "own_model", *sizes)


def _modelled(
    answers: DataFrame, configs: DataFrame, models: DataFrame, vocabulary: DataFrame, lowercase: bool
) -> DataFrame:
    if lowercase:
        answers = answers.withColumn("text", F.lower("text"))
    asked = lookup.fan_out(answers, configs.select(*KEYS, "pos", "ideal"))
    rows = asked.select("answer_id", *KEYS, F.coalesce("pos", F.lit(-1)).alias("pos"), "text")
    trained = models.filter(F.col("lesson") != fixed.DEFAULT_LESSON)
    settings = scoring_settings(configs, rows, trained)
    features = assembly.assemble(
        rows, settings, vocabulary,
        F.col(fixed.FEATURE_LENGTH_RATIO), F.col(fixed.FEATURE_REGEX_AGGREGATE_DISABLED),
    )
    modelled = lookup.with_model(features.withColumn("arch", F.lit(fixed.ARCH_REGRESSION)), models)
    return scoring.with_speech_acts(scoring.score(modelled))
