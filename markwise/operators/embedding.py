"""Word vectors: vocabulary join, mean vectors, similarities, slim export."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import vectors
from markwise.operators.skew import SALTS
from markwise.session import written

BROADCAST_BYTES = 64 << 20
#: Words of the texts that share one copy of their words' vectors.
BLOCK_WORDS = 1 << 20
#: Words of the texts that a task lays out with their vectors at a time.
PACKED_WORDS = 1 << 18
#: Words whose vectors are summed at a time.
SUMMED_WORDS = 1 << 15


def vector_width(vocabulary: DataFrame) -> int:
    return vocabulary.select(F.size("vector")).first()[0]


def join_vocabulary(
    words: DataFrame,
    vocabulary: DataFrame,
    spread: str | list[str],
    limit: int = BROADCAST_BYTES,
    how: str = "inner",
) -> DataFrame:
    """Join (…, word) rows with the vocabulary; unknown words drop out, or keep
    a null vector if ``how`` is left.

    The vocabulary is broadcast where its counted size is within ``limit``.
    Beyond that the rows are dealt and sorted by a hash of the word, which is cheaper
    to sort than the word, salted because a few words make up most of any text.
    """
    vocabulary = vocabulary.select("word", "vector")
    size = vocabulary.agg(F.coalesce(F.sum(F.size("vector") * 8 + F.length("word") + 32), F.lit(0))).first()[0]
    if size <= limit:
        return words.join(F.broadcast(vocabulary), "word", how)
    columns = [spread] if isinstance(spread, str) else spread
    salt = F.expr(f"pmod(xxhash64({', '.join(f'`{c}`' for c in columns)}), {SALTS}L)")
    many = words.withColumn("_code", F.xxhash64("word", salt))
    repeated = vocabulary.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    few = repeated.select(F.xxhash64("word", "_salt").alias("_code"), F.col("word").alias("_word"), "vector")
    # equal words by two comparisons, as an equality would be sorted by, too
    same = (F.col("word") >= F.col("_word")) & (F.col("word") <= F.col("_word"))
    joined = many.alias("m").join(few.alias("f"), (F.col("m._code") == F.col("f._code")) & same, how)
    return joined.select("word", *[f"m.`{c}`" for c in words.columns if c != "word"], "vector")


def _running_blocks(block_words: int):
    @F.pandas_udf("bigint")
    def number(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        total = 0
        for size in sizes:
            sums = size.fillna(0).clip(lower=0).astype("int64").cumsum() + total
            total = int(sums.iloc[-1]) if len(sums) else total
            yield sums // block_words

    return number


def by_block(
    rows: DataFrame, tokens: list[str], vocabulary: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows, block by block, with the vectors of the words in their ``tokens`` columns.

    A block is a run of rows with about ``block_words`` words. Within it every
    known word is sent once, however many rows have it, so what is shuffled
    grows with the blocks and not with words times the width of a vector.
    ``work`` gets the rows of a block and its (word, vector) rows.
    """
    size = sum((F.coalesce(F.size(t), F.lit(0)) for t in tokens), F.lit(0))
    place = F.struct(F.spark_partition_id().alias("part"), _running_blocks(block_words)(size).alias("number"))
    blocked = written(rows.withColumn("_block", place), "blocks")
    none = F.expr("CAST(array() AS array<string>)")
    words = F.explode(F.concat(*[F.coalesce(t, none) for t in tokens]))
    # few words are broadcast by the size of their file, and the vocabulary stays where it is
    words = written(blocked.select(F.col("_block").alias("_of"), words.alias("word")).distinct(), "words")
    known = words.join(vocabulary.filter("vector IS NOT NULL").select("word", "vector"), "word")
    return blocked.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(work, schema)


def block_vectors(known: pa.Table, width: int) -> tuple[pa.Array, np.ndarray]:
    """The words of a block's (word, vector) rows and their vectors as a matrix."""
    known = known.combine_chunks()
    if not known.num_rows:
        return pa.array([], pa.string()), np.zeros((0, width))
    flat = pc.fill_null(pc.list_flatten(known["vector"]).combine_chunks(), 0)
    return known["word"].combine_chunks(), flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def summed_vectors(words: pa.Array, matrix: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the sums of their vectors and how many these are: a word
    with several vectors counts with each."""
    coded = words.dictionary_encode()
    if len(coded.dictionary) == len(words):
        return words, matrix, np.ones(len(words), np.int64)
    at, sums = coded.indices.to_numpy(), np.zeros((len(coded.dictionary), matrix.shape[1]))
    np.add.at(sums, at, matrix)
    return coded.dictionary, sums, np.bincount(at)


def _block_sums(key: list[str], width: int, mean: bool = False):
    """Per row how many vectors its words have and their sum, or mean."""

    def sums(rows: pa.Table, known: pa.Table) -> pa.Table:
        words, matrix, times = summed_vectors(*block_vectors(known, width))
        lists = rows["_words"].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=words), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)[at >= 0]
        at = at[at >= 0]
        found = np.zeros((len(lengths), width))
        for start in range(0, len(at), SUMMED_WORDS):
            part = row[start : start + SUMMED_WORDS]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            found[part[first]] += np.add.reduceat(matrix[at[start : start + SUMMED_WORDS]].astype(np.float64), first, axis=0)
        n_known = np.bincount(row, times[at], minlength=len(lengths)).astype(np.int64)
        if mean:
            found /= np.maximum(n_known, 1)[:, None]
        ends = pa.array(np.arange(len(lengths) + 1) * width, pa.int32())
        return pa.table(
            [*[rows[k] for k in key], pa.array(n_known), pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))],
            [*key, "n_known", "vector" if mean else "_sums"],
        )

    return sums


def mean_vectors(
    texts: DataFrame, vocabulary: DataFrame, key: list[str], tokens: str = "tokens", unique: bool = False
) -> DataFrame:
    """Mean over the distinct known words of each text: (key…, n_known, vector).

    ``key`` is unique per row of ``texts``. Sums are made in blocks of texts,
    and one row per text is shuffled; with ``unique``, which says that no key can
    come twice, the means are made in the blocks and nothing is shuffled after them.
    Texts without a known word get the zero vector.
    """
    width = vector_width(vocabulary)
    rows = texts.select(*key, F.array_distinct(tokens).alias("_words"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in key) + ", n_known bigint, "
    if unique:
        return by_block(rows, ["_words"], vocabulary, _block_sums(key, width, mean=True), schema + "vector array<double>")
    schema += "_sums array<double>"
    found = by_block(rows, ["_words"], vocabulary, _block_sums(key, width), schema)
    sums = found.groupBy(*key).agg(
        F.sum("n_known").alias("n_known"), *[F.expr(f"sum(_sums[{i}]) AS s{i}") for i in range(width)]
    )
    zero = F.array_repeat(F.lit(0.0), width)
    mean = F.expr(f"array({', '.join(f's{i} / n_known' for i in range(width))})")
    return sums.select(*key, "n_known", F.when(F.col("n_known") > 0, mean).otherwise(zero).alias("vector"))


def _block_words(key: list[str], width: int):
    def pack(rows: pa.Table, known: pa.Table) -> pa.Table:
        words, matrix = block_vectors(known, width)
        order = pc.sort_indices(words).to_numpy()
        if pc.count_distinct(words).as_py() < len(words):  # several vectors of a word are in their order, too
            order = np.array(sorted(order.tolist(), key=lambda k: (words[k].as_py(), matrix[k].tolist())))
        coded = words.take(pa.array(order)).dictionary_encode()
        times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        starts = np.cumsum(times) - times
        lists = rows["_words"].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)[at >= 0]
        at = at[at >= 0]
        sort = np.lexsort((at, row))
        row, at = row[sort], at[sort]
        n = times[at]
        place = order[np.repeat(starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        ends = np.r_[0, np.cumsum(np.bincount(row, n, minlength=len(lengths)).astype(np.int64))]
        vectors = pa.array(matrix[place].astype(np.float32).reshape(-1))
        return pa.table(
            [
                *[rows[k] for k in key],
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(place))),
                pa.ListArray.from_arrays(pa.array(ends * width, pa.int32()), vectors),
            ],
            [*key, "known_words", "known_vectors"],
        )

    return pack


def known_words(
    texts: DataFrame, vocabulary: DataFrame, key: list[str], tokens: str = "tokens"
) -> DataFrame:
    """(key…, known_words, known_vectors): the known distinct words of each
    text, sorted, with their vectors laid end to end.

    ``key`` is unique per row of ``texts``. A block of texts gets the vectors of
    its distinct words once, so that the vocabulary is not repeated for frequent words.
    """
    rows = texts.select(*key, F.array_distinct(tokens).alias("_words"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in key) + ", known_words array<string>, known_vectors array<float>"
    return by_block(rows, ["_words"], vocabulary, _block_words(key, vector_width(vocabulary)), schema, PACKED_WORDS)


def archetype_similarities(vector: Column, archetypes: Column) -> Column:
    """One cosine per archetype mean vector, in archetype order."""
    return F.transform(archetypes, lambda archetype: vectors.cosine(vector, archetype))


def slim_words(expectations: DataFrame) -> DataFrame:
    """Distinct (lesson, word) needed to score a lesson without the full vectors."""
    none = "CAST(array() AS array<string>)"
    archetypes = f"flatten(transform(coalesce(archetypes, {none}), a -> split(lower(a), ' ')))"
    patterns = f"flatten(transform(coalesce(patterns, {none}), p -> split(p, ' [+] ')))"
    words = f"concat(ideal_tokens, question_tokens, {archetypes}, {patterns})"
    return expectations.select("lesson", F.explode(F.expr(f"array_distinct({words})")).alias("word")).distinct()


def slim_embeddings(expectations: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lesson, word, vector) with slim-vocabulary vectors rounded for export."""
    known = join_vocabulary(slim_words(expectations), vocabulary.filter("in_slim"), "lesson")
    return known.select("lesson", "word", vectors.rounded(F.col("vector").cast("array<double>")).alias("vector"))


