"""Export of what is needed to score a lesson elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators import lookup

KEYS = ["lesson", "exp_num"]
LISTS = ["archetype_good", "archetype_bad", "patterns_good", "patterns_bad"]
FLAGS = [
    fixed.FEATURE_LENGTH_RATIO,
    fixed.FEATURE_REGEX_AGGREGATE_DISABLED,
    fixed.FEATURE_ARCHETYPE_ENABLED,
    fixed.FEATURE_PATTERNS_ENABLED,
]


def model_extract(configs: DataFrame, models: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """(lesson, extract[, embedding]): one JSON object per lesson, an entry per
    expectation with its weights (own or default), ideal, regexes, flags,
    patterns and archetypes; the slim embeddings as a second object."""
    rows = lookup.first_configs(configs).withColumn("arch", F.lit(fixed.ARCH_REGRESSION))
    rows = lookup.with_model(rows, models, "exp_num")
    none = F.expr("CAST(array() AS array<string>)")
    entry = F.struct(
        "ideal",
        F.coalesce("good", none).alias("regex_good"),
        F.coalesce("bad", none).alias("regex_bad"),
        *[(F.coalesce(F.col(c), none) if c in configs.columns else none).alias(c) for c in LISTS],
        *[F.col(c) for c in FLAGS if c in configs.columns],
    )
    null = F.lit("null")
    pair = F.concat_ws(",", F.coalesce(F.to_json("coef"), null), F.coalesce(F.col("intercept").cast("string"), null))
    rest = F.substr(F.to_json(entry), F.lit(2))
    with_weights = F.concat(F.lit('{"weights_bias":['), pair, F.lit("],"), rest)
    # a lesson has as many entries as its config has expectations
    together = rows.groupBy("lesson").agg(F.array_sort(F.collect_list(F.struct("exp_num", with_weights.alias("json")))).alias("all"))
    quoted = lambda id_: F.regexp_extract(F.to_json(F.struct(id_.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    pairs = F.transform("all", lambda e: F.concat(quoted(e["exp_num"]), F.lit(":"), e["json"]))
    extract = together.select("lesson", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("extract"))
    if embeddings is None:
        return extract
    # words of a lesson's ideals, question, archetypes and patterns: a short list
    words = embeddings.groupBy("lesson").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "vector"))))).alias("embedding"))
    return extract.join(words, "lesson", "left")
