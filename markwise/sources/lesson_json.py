"""Lesson exports: a JSON document holding a config and a CSV as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise import schemas

# a CSV record: anything but newlines, except inside quotes
RECORD = r'(?:[^"\n]++|"(?:[^"]++|"")*+")++'


def unpack_exports(documents: DataFrame, column: str) -> DataFrame:
    """(…, config, training) of export documents; both levels of nesting occur."""
    nested = "data struct<trainingData: struct<config: string, training: string>, " + schemas.LESSON_EXPORT[len("data struct<"):]
    data = F.from_json(column, nested)["data"]
    found = F.coalesce(data["me"]["trainingData"], data["trainingData"])
    rest = [c for c in documents.columns if c != column]
    return documents.select(*rest, found["config"].alias("config"), found["training"].alias("training"))


def csv_records(blob: Column) -> Column:
    """The records of a CSV string, header dropped, quoted newlines kept."""
    records = F.regexp_extract_all(blob, F.lit(RECORD), F.lit(0))
    return F.slice(records, F.lit(2), F.greatest(F.size(records) - 1, F.lit(0)))


def training_rows(exports: DataFrame, keep: list[str]) -> DataFrame:
    """Explode the CSV string of each export into (keep…, exp_num, text, label)."""
    options = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\u0001"}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    record = F.from_csv("record", schemas.TRAINING_CSV, options)
    return (
        exports.select(*keep, F.explode(csv_records(F.col("training"))).alias("record"))
        .select(*keep, record.alias("r"))
        .select(*keep, "r.exp_num", "r.text", "r.label")
    )
