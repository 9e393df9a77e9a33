"""Finding the config and the model that apply to a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators.skew import salted_join

KEYS = ["lesson", "exp_num"]


def first_configs(expectations: DataFrame) -> DataFrame:
    """One row per (lesson, exp_num): of duplicate ids the first position wins."""
    rest = [c for c in expectations.columns if c not in KEYS]
    first = F.min_by(F.struct(*rest), "pos").alias("first")
    return expectations.groupBy(*KEYS).agg(first).select(*KEYS, "first.*")


def with_config(rows: DataFrame, expectations: DataFrame, spread: str) -> DataFrame:
    """Left join to the configs; an unknown id gets an empty ideal and no features."""
    joined = salted_join(rows, first_configs(expectations), KEYS, spread)
    return joined.withColumn("ideal", F.coalesce("ideal", F.lit("")))


def trainable_rows(training: DataFrame, keep: DataFrame) -> DataFrame:
    return salted_join(training, keep.select(*KEYS), KEYS, "row_id", "left_semi")


def fan_out(answers: DataFrame, expectations: DataFrame) -> DataFrame:
    """One row per answer and expectation asked for.

    A null or empty ``exp_num`` asks for all of the lesson's expectations in
    config order; a named one is kept even where the config does not know it.
    """
    asked = answers.withColumn("exp_num", F.when(F.length("exp_num") > 0, F.col("exp_num")))
    configs = first_configs(expectations)
    ids = configs.groupBy("lesson").agg(F.array_sort(F.collect_list(F.struct("pos", "exp_num"))).alias("_ids"))
    each = salted_join(asked.filter("exp_num IS NULL").drop("exp_num"), ids, ["lesson"], "answer_id", "inner")
    each = each.select("*", F.explode("_ids.exp_num").alias("exp_num")).drop("_ids")
    named = asked.filter("exp_num IS NOT NULL")
    return with_config(each.unionByName(named), configs, "answer_id")


def default_models(models: DataFrame) -> DataFrame:
    """One default model per architecture (the first by expectation id)."""
    return (
        models.filter(F.col("lesson") == fixed.DEFAULT_LESSON)
        .groupBy("arch")
        .agg(F.min_by(F.struct("coef", "intercept"), "exp_num").alias("d"))
        .select("arch", F.col("d.coef").alias("default_coef"), F.col("d.intercept").alias("default_intercept"))
    )


def with_model(rows: DataFrame, models: DataFrame, spread: str = "answer_id") -> DataFrame:
    """Own model by (arch, lesson, exp_num), else the architecture's default.

    There is one default per architecture, a few dozen numbers each, so these
    go into the plan as values; the own-model join splits hot expectations.
    """
    own = models.select("arch", *KEYS, "coef", "intercept")
    joined = salted_join(rows, own, ["arch", *KEYS], spread)
    coef, intercept = F.col("coef"), F.col("intercept")
    for default in default_models(models).collect():
        missing = F.col("coef").isNull() & (F.col("arch") == default.arch)
        coef = F.when(missing, F.array(*[F.lit(float(c)) for c in default.default_coef])).otherwise(coef)
        intercept = F.when(missing, F.lit(float(default.default_intercept))).otherwise(intercept)
    return joined.withColumns({"own_model": F.col("coef").isNotNull(), "coef": coef, "intercept": intercept})


def resolve_store(requested: DataFrame, local: DataFrame, deployed: DataFrame, default: DataFrame) -> DataFrame:
    """(lesson, origin, model columns…): local copy, else deployed, else default.

    ``is_default`` tells the scorer to leave generated patterns and archetypes
    aside. ``default`` holds one row.
    """
    def ranked(rows: DataFrame, place: int, origin: str) -> DataFrame:
        return rows.withColumn("_place", F.lit(place)).withColumn("origin", F.lit(origin))

    stored = ranked(local, 0, "local").unionByName(ranked(deployed, 1, "deployed"))
    rest = [c for c in stored.columns if c not in ("lesson", "_place")]
    best = stored.groupBy("lesson").agg(F.min_by(F.struct(*rest), "_place").alias("m"))
    spare = default.first().asDict() | {"origin": "default"}
    joined = requested.join(best, "lesson", "left")

    def pick(name: str):
        return F.when(F.col("m").isNotNull(), F.col(f"m.{name}")).otherwise(F.lit(spare[name])).alias(name)

    names = [c for c in spare if c != "lesson"]
    return joined.select(*requested.columns, *[pick(name) for name in names], F.col("m").isNull().alias("is_default"))


def stale_lessons(cached: DataFrame, trained: DataFrame, lessons: DataFrame) -> DataFrame:
    """Cached lessons to reload: retrained, or edited, after the copy was taken.

    ``cached``: (lesson, trained_at, updated_at); ``trained``: (lesson,
    trained_at); ``lessons``: (lesson, updated_at).
    """
    now = trained.groupBy("lesson").agg(F.max("trained_at").alias("now_trained"))
    edited = lessons.groupBy("lesson").agg(F.max("updated_at").alias("now_updated"))
    compared = cached.join(now, "lesson", "left").join(edited, "lesson", "left")
    return compared.select(
        "lesson",
        F.coalesce(F.col("now_trained") > F.col("trained_at"), F.lit(False)).alias("retrained"),
        F.coalesce(F.col("now_updated") > F.col("updated_at"), F.lit(False)).alias("edited"),
    ).filter("retrained OR edited")
