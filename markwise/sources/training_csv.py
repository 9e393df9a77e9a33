"""Labelled answers as CSV, and test sets in the same format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise import schemas

# --- fixed values: the file format -----------------------------------------
# files that the service keeps hold one byte a character
SERVICE_ENCODING = "ISO-8859-1"
CSV_OPTIONS = {
    "header": "true",
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# a file with newlines in its fields is read by one task as a whole
FILE_ROWS = 20_000


def read_training(
    spark: SparkSession, path: str, schema: str = schemas.TRAINING_CSV, encoding: str = CSV_OPTIONS["encoding"]
) -> DataFrame:
    """(exp_num, text, label) as strings; quoted fields may hold newlines.

    What ``write_training`` wrote is UTF-8; files of the service are read with ``SERVICE_ENCODING``.
    """
    return spark.read.schema(schema).options(**{**CSV_OPTIONS, "encoding": encoding}, multiLine="true").csv(path)


def read_default_training(spark: SparkSession, path: str, encoding: str = CSV_OPTIONS["encoding"]) -> DataFrame:
    """Rows pooled over lessons, with their question and ideal unpacked."""
    return unpack_exp_data(read_training(spark, path, schemas.DEFAULT_TRAINING_CSV, encoding))


def unpack_exp_data(rows: DataFrame) -> DataFrame:
    data = F.from_json("exp_data", schemas.EXP_DATA)
    return rows.withColumn("question", data["question"]).withColumn("ideal", data["ideal"]).drop("exp_data")


def write_training(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One CSV set per lesson (or as ``partition_by`` says), readable by the scan, in files of bounded size."""
    writer = rows.write.mode("overwrite").options(**CSV_OPTIONS, quoteAll="true", maxRecordsPerFile=FILE_ROWS)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def expected_results(
    rows: DataFrame, threshold: float = fixed.CONFIDENCE_THRESHOLD, strict: bool = True
) -> DataFrame:
    """Test-set rows with what is expected of the score.

    A row labelled exactly good or bad must score at least ``threshold`` (GTE);
    any other label means neutral: the score must stay below it (LT).
    ``strict=False`` also accepts padded or capitalised labels.
    """
    from markwise.functions import text

    label = F.coalesce("label", F.lit(""))
    if not strict:
        label = text.normalise_label(label)
    return rows.withColumn("label", label).select(
        "*",
        F.when(F.col("label").isin(fixed.GOOD, fixed.BAD), "GTE").otherwise("LT").alias("comparison"),
        F.lit(threshold).alias("threshold"),
    )
