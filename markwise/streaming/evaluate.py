"""Scoring a stream of answers with tables that are retrained meanwhile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markwise.plans.evaluate import evaluate
from markwise.session import written

# (configs, models, vocabulary), read again for every micro-batch
Tables = Callable[[], tuple[DataFrame, DataFrame, DataFrame]]


def split_requests(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that name a lesson and bring a text, and those that do not."""
    reason = F.when(F.coalesce(F.length("lesson"), F.lit(0)) == 0, "lesson is missing").when(
        F.col("text").isNull(), "text is missing"
    )
    marked = answers.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def evaluate_stream(
    answers: DataFrame, tables: Tables, results: str, rejected: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Starts the stream: (answer_id, lesson, exp_num, text) to two tables.

    Nothing is kept between batches. A batch writes its own folder and
    replaces it when it is run again, so a batch repeated after a failure
    leaves no duplicates. The source is read once per batch.
    """

    def score(batch: DataFrame, number: int) -> None:
        valid, invalid = split_requests(written(batch, "batch"))
        configs, models, vocabulary = tables()
        evaluate(valid, configs, models, vocabulary).write.mode("overwrite").parquet(f"{results}/batch={number}")
        invalid.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    writer = answers.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
