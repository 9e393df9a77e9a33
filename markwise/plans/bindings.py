"""The engine's relations, derived from the given tables.

lesson      = documents.lang; question = the benchmark item at its position
expectation = '0' (the answer is of quality) and '1' (the answer is not toxic)
answers     = whole document texts with the labels of both expectations
vocabulary  = all words of the documents, each with one of the embeddings
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import text

LESSONS = ["de", "en", "es", "fr"]
# of 256 parts that words fall into by their hash, those in the slim vocabulary
SLIM_PARTS = 64
IDEAL_MIN_CHARS = 150
#: Bytes of texts that are cut at spaces at a time.
CUT_BYTES = 1 << 23
#: Runs that a task gathers before it deals them, those it hashes at a time, and parts they are dealt to for each partition of a shuffle.
RUNS_AT_ONCE, HASHED_AT_ONCE, PARTS = 1 << 20, 1 << 16, 4

GOOD_REGEXES = {"0": ["[Tt]h[ae]", "ung", "[0-9]{2}"], "1": ["ion", "^[A-Z]"]}
BAD_REGEXES = {"0": ["[|]", "licen[sc]e"], "1": ["idiot|stupid|worthless", "[!]{2}", "http"]}


# tables of whole texts, with a key to spread them by
TEXTS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as it lies. Where texts lie in a single small file, a job
    can ask for them to be spread first (``spark.markwise.textSplits``)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    splits = int(spark.conf.get("spark.markwise.textSplits", "0"))
    return rows.repartition(splits, *TEXTS[name]) if splits and name in TEXTS else rows


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its rows, be it a file or a folder of files."""
    # by a pattern, as a stream's path itself has to be a folder
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def raw_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lesson, exp_num, row_id, text, label) with labels as people type them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels")
    quality = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 1), " GOOD ")
        .when(F.col("quality") == 1, "Good")
        .when(F.col("toxic") == 1, "unsure")
        .otherwise("bad")
    )
    safety = F.when(F.col("toxic") == 0, "good").otherwise("Bad ")
    both = F.array(
        F.struct(F.lit("0").alias("exp_num"), quality.alias("label")),
        F.struct(F.lit("1").alias("exp_num"), safety.alias("label")),
    )
    return (
        documents.join(labels, "doc_id")
        .select(F.col("lang").alias("lesson"), F.col("doc_id").alias("row_id"), "text", F.inline(both))
        .select("lesson", "exp_num", "row_id", "text", "label")
    )


def regex_column(table_: dict[str, list[str]]):
    quoted = [f"WHEN exp_num = '{exp}' THEN array({', '.join(f'r{chr(39)}{rx}{chr(39)}' for rx in rxs)})" for exp, rxs in table_.items()]
    return F.expr(f"CASE {' '.join(quoted)} ELSE CAST(array() AS array<string>) END")


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lesson, exp_num, pos, question, ideal, good, bad): shortest good answers are the ideals."""
    candidates = raw_training(spark, sf_dir).filter(
        (text.normalise_label(F.col("label")) == fixed.GOOD) & (F.length("text") >= IDEAL_MIN_CHARS)
    )
    ideals = candidates.groupBy("lesson", "exp_num").agg(
        F.min_by("text", F.struct(F.length("text"), "row_id")).alias("ideal")
    )
    place = F.array_position(F.lit(LESSONS), F.col("lesson")) - 1
    questions = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return (
        ideals.withColumn("item_id", place)
        .join(questions, "item_id", "left")
        .select(
            "lesson",
            "exp_num",
            F.col("exp_num").cast("int").alias("pos"),
            "question",
            "ideal",
            regex_column(GOOD_REGEXES).alias("good"),
            regex_column(BAD_REGEXES).alias("bad"),
        )
    )


def _cut(column: pa.Array) -> pa.Array:
    """What stands between the spaces and line ends of texts, once each."""
    texts = column.drop_null().cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        return pa.array([], pa.string())
    letters = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    last = (letters == ord(" ")) | (letters == ord("\n"))
    last[ends[1:][ends[1:] > ends[0]] - ends[0] - 1] = True
    # each run lies there with the letter that ends it
    places = np.r_[0, np.flatnonzero(last) + 1].astype(np.int32)
    runs = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(letters)).unique()
    return pc.ascii_rtrim(runs, " \n").unique()


def distinct_runs(texts: DataFrame) -> DataFrame:
    """(run): what stands between the spaces and line ends of the only column, once each.

    A task gathers the runs of its texts, deals them by a hash and sends them on in lists, so a
    list is shuffled and not its many short strings.
    """
    parts = PARTS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(found: list[pa.Array]) -> pa.RecordBatch:
        runs = pa.concat_arrays(found).unique()
        some = (runs.slice(i, HASHED_AT_ONCE).to_numpy(zero_copy_only=False) for i in range(0, len(runs), HASHED_AT_ONCE))
        part = np.concatenate([pd.util.hash_array(few, categorize=False) for few in some]) % parts
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), runs.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), lists], ["part", "runs"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            column = batch.column(0)
            rows = max(1, CUT_BYTES * len(column) // max(1, column.nbytes))
            for start in range(0, len(column), rows):
                found.append(_cut(column.slice(start, rows)))
                size += len(found[-1])
                if size > RUNS_AT_ONCE:
                    found = [pa.concat_arrays(found).unique()]
                    size = len(found[0])
                if size > RUNS_AT_ONCE // 2:
                    yield dealt(found)
                    found, size = [], 0
        if size:
            yield dealt(found)

    def once(lists: pa.Table) -> pa.Table:
        return pa.table([pc.list_flatten(lists["runs"].combine_chunks()).unique()], ["run"])

    sent = texts.mapInArrow(gathered, "part long, runs array<string>").filter("size(runs) > 0")
    return sent.groupBy("part").applyInArrow(once, "run string")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, in_slim, vector): every word, with a vector picked by hash."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n_vectors = embeddings.count()
    # nothing of the normalisation reaches across a space, so each run between spaces goes through it once
    runs = distinct_runs(table(spark, sf_dir, "documents").select("text"))
    spaced = f'regexp_replace({text.punctuation_sql("lower(run)")}, r"{text.SPACE}+", " ")'
    # letters and digits alone are only lowered
    cut = f"CASE WHEN run RLIKE '^[A-Za-z0-9]+$' THEN array(lower(run)) ELSE split({spaced}, ' ') END"
    words = runs.select(F.explode(F.expr(cut)).alias("word")).filter("word <> ''").distinct()
    code = F.md5("word")
    part = F.conv(F.substring(code, 8, 2), 16, 10).cast("int")
    vec_id = F.conv(F.substring(code, 1, 7), 16, 10).cast("bigint") % n_vectors
    return (
        words.select("word", (part < SLIM_PARTS).alias("in_slim"), vec_id.alias("vec_id"))
        .join(embeddings, "vec_id")
        .select("word", "in_slim", "vector")
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled answers: user turns of the conversations, whole texts.

    Every turn is asked for all expectations of its lesson, except that odd
    conversations name one expectation each.
    """
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    lesson = F.element_at(F.lit(LESSONS), (F.col("conv_id") % len(LESSONS) + 1).cast("int"))
    asked = F.when(F.col("conv_id") % 2 == 1, (F.col("turn") % 3).cast("string"))
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("answer_id"),
        lesson.alias("lesson"),
        asked.alias("exp_num"),
        "text",
    )
