"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage takes the documents its predecessor kept, decides over all of
them, and returns the columns of ``documents``; the last returns packed pieces.
Null ids and texts, empty tables and repeated rows go by the results that the
operators of ``markwise.llm`` define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.llm.batches import table
from markwise.llm.chunked_encoding import vocabulary_path
from markwise.llm.language_mixture import NONE, fit_languages, identify
from markwise.llm.near_duplicates import BROADCAST_BYTES, near_duplicates
from markwise.llm.packing import pack
from markwise.llm.quality_rules import quality_rules
from markwise.session import written

#: Least share of the predicted language in a document.
LEAST_SHARE = 0.5
#: Least probability that a document is of quality.
LEAST_QUALITY = 0.5
#: Similarity of word shingles, in percent, from which documents are near duplicates.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, and one language that makes up half of them or more."""
    models = fit_languages(docs, "text", "lang", "doc_id")
    found = identify(docs, models)
    return found.filter((F.col("lang_pred") != NONE) & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with a posterior probability of a half or more."""
    return quality_rules(docs).filter(F.col("p_good") >= LEAST_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates."""
    dropped = written(near_duplicates(docs, percent=NEAR_PERCENT).filter("NOT kept").select("doc_id").distinct(), "dropped")
    if dropped.count() * 8 <= BROADCAST_BYTES:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    return pack(docs, vocabulary_path("byte_bpe_50k.json"), keep=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Mixtures, posteriors and encodings have no SQL; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
