"""Lesson configs: question, expectations and their features."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise import schemas
from markwise.functions.config_values import escape_features, flag, unescape_features

LISTS = ["good", "bad", "archetype_good", "archetype_bad", "patterns_good", "patterns_bad"]
FLAGS = [
    "featureLengthRatio",
    "featureRegexAggregateDisabled",
    "featureDbScanClustersArchetypeEnabled",
    "featureDbScanClustersPatternsEnabled",
]

_NO_EXTRAS = "CAST(map() AS map<string,string>)"


def _yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("YAML configs need PyYAML on the executors; JSON configs do not") from missing
    for batch in batches:
        batch["config"] = [json.dumps(yaml.safe_load(text or "")) for text in batch["config"]]
        yield batch


def read_configs(spark: SparkSession, path: str, yaml: bool = False) -> DataFrame:
    """(lesson, config) of files stored as <lesson>/config.json (or .yaml)."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"(?:lesson=)?([^/]+)/[^/]+$", 1).alias("lesson"),
        F.col("value").alias("config"),
    )
    return configs_from_yaml(files) if yaml else files


def configs_from_yaml(configs: DataFrame) -> DataFrame:
    return configs.mapInPandas(_yaml_to_json, configs.schema)


def _extras(expectation: str) -> Column:
    """The features that have no column, each as its JSON."""
    known = ", ".join(f"'{name}'" for name in [*LISTS, *FLAGS])
    features = f"variant_get({expectation}, '$.features', 'map<string,variant>')"
    return F.expr(
        f"coalesce(transform_values(map_filter({features}, (k, v) -> k NOT IN ({known})), (k, v) -> to_json(v)), "
        f"{_NO_EXTRAS})"
    )


def explode_config(configs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, question, pos, exp_num, ideal, lists…, flags…, extras), values unescaped.

    Features under other names are kept as they came: ``extras`` maps a name
    to its JSON, and ``config_json`` writes it back.
    """
    variant = F.variant_get(F.try_parse_json("config"), "$.expectations", "array<variant>")
    parsed = configs.select(*keep, F.from_json("config", schemas.LESSON_CONFIG).alias("c"), variant.alias("v"))
    both = F.arrays_zip(F.col("c.expectations").alias("e"), F.col("v").alias("v"))
    rows = parsed.select(*keep, F.col("c.question").alias("question"), F.posexplode(both).alias("pos", "b"))
    rows = rows.select(*keep, "question", "pos", F.col("b.e").alias("e"), F.col("b.v").alias("v"))
    empty = F.expr("CAST(array() AS array<string>)")
    return rows.select(
        *keep,
        "question",
        "pos",
        F.coalesce("e.expectation_id", "e.expectationId").alias("exp_num"),
        F.coalesce("e.ideal", F.lit("")).alias("ideal"),
        *[unescape_features(F.coalesce(f"e.features.{name}", empty)).alias(name) for name in LISTS],
        *[flag(F.col(f"e.features.{name}")).alias(name) for name in FLAGS],
        _extras("v").alias("extras"),
    )


def _with_extras(features: Column, extras: Column) -> Column:
    """The JSON of an object with more members; the added ones are JSON already."""
    members = F.transform(
        F.array_sort(F.map_entries(extras)),
        lambda m: F.concat(F.regexp_extract(F.to_json(F.struct(m["key"].alias("k"))), r'^\{"k":(.*)\}$', 1), F.lit(":"), m["value"]),
    )
    inner = F.regexp_extract(F.to_json(features), r"(?s)^\{(.*)\}$", 1)
    return F.concat(F.lit("{"), F.array_join(F.concat(F.array(inner), members), ","), F.lit("}"))


def config_json(expectations: DataFrame) -> DataFrame:
    """(lesson, config) JSON strings back from exploded rows, values escaped."""
    none = F.expr("CAST(array() AS array<string>)")
    lists = [
        escape_features(F.coalesce(F.col(name), none) if name in expectations.columns else none).alias(name)
        for name in LISTS
    ]
    flags = [(F.col(name) if name in expectations.columns else F.lit(False)).alias(name) for name in FLAGS]
    extras = F.coalesce(F.col("extras"), F.expr(_NO_EXTRAS)) if "extras" in expectations.columns else F.expr(_NO_EXTRAS)
    features = _with_extras(F.struct(*lists, *flags), extras)
    entry: Column = F.struct(
        "pos", F.struct(F.col("exp_num").alias("expectation_id"), "ideal", features.alias("features")).alias("e")
    )
    together = expectations.groupBy("lesson").agg(
        F.max("question").alias("question"), F.array_sort(F.collect_list(entry)).alias("entries")
    )
    written_out = F.transform(
        "entries.e",
        lambda e: F.struct(e["expectation_id"].alias("expectation_id"), e["ideal"].alias("ideal"), F.parse_json(e["features"]).alias("features")),
    )
    return together.select("lesson", F.to_json(F.struct("question", written_out.alias("expectations"))).alias("config"))
