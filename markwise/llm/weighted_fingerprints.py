"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur. For every
sample, a term draws gamma variates that depend on the term alone; together
with the weight they give a rank, and the term of least rank is the sample,
with the quantised weight at which it won. Two texts agree in a sample with
the probability of their generalised Jaccard similarity (sum of the smaller
over sum of the larger weights), so the share of equal samples estimates it.

A fingerprint holds ``SAMPLES`` samples of 16 bits each, as hexadecimal text;
unequal samples look equal once in 65536 times. A null, empty or blank text has no
terms: its samples are all zero, and it is like other empty texts (1) and
unlike all others (0 up to such accidents).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, emit, table, texts_of
from markwise.llm.words import WordHashes, mixed

SAMPLES = 64
#: Rows of ranks made at a time (they stay in the cache), and texts that share them.
SLAB, TEXTS_AT_ONCE = 128, 512
#: Bytes of texts whose terms share ranks, and rows compared at a time: bounds of memory.
BYTES_AT_ONCE, ROWS_AT_ONCE = 6 << 20, 1 << 16
#: Parts of the order for each task; several even out their sizes.
PARTS_PER_TASK = 4


def uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the upper 23 of 32 bits, as the mantissas of 1.x."""
    return (bits >> np.uint32(9) | np.uint32(0x3F800000)).view(np.float32) - np.float32(1 - 2.0**-24)


def halves(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32)


class WeightedSampler:
    def __init__(self, samples: int = SAMPLES, seed: int = 7):
        self.samples = samples
        self.hashes = WordHashes()
        self.seeds = mixed(np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)).reshape(3, samples)

    def ranks(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One row per weighted term: rank in the upper, identity in the lower
        32 bits, so that the least number of a column is its sample."""
        (a, b), (c, d), (e, own) = (halves(mixed(terms[:, None] ^ seeds)) for seeds in self.seeds)
        # a gamma variate of shape 2 is the negative logarithm of two uniforms' product
        r = -np.log(uniform(a) * uniform(b))
        log_c = np.log(-np.log(uniform(c) * uniform(d)))
        beta = uniform(e)
        t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + beta)
        rank = (log_c - r * (t - beta + 1)).view(np.int32)
        ordered = np.where(rank < 0, ~rank, rank ^ np.int32(-(2**31))).view(np.uint32)
        which = own + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        return ordered.astype(np.uint64) << np.uint64(32) | which

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The samples of each text, two bytes each."""
        found: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > BYTES_AT_ONCE:
                found += self._together(texts[start:i])
                start, size = i, 0
            size += len(text)
        return found + self._together(texts[start:])

    def _together(self, texts: list[bytes]) -> list[bytes]:
        place: dict[tuple[bytes, int], int] = {}
        rows: list[int] = []
        ends = []
        for text in texts:
            rows += [place.setdefault(item, len(place)) for item in Counter(text.split()).items()]
            ends.append(len(rows))
        out = np.zeros((len(texts), self.samples), np.uint16)
        if rows:
            terms = self.hashes.of([word for word, _ in place])
            weights = np.array([n for _, n in place])
            made = np.concatenate(
                [self.ranks(terms[i : i + SLAB], weights[i : i + SLAB]) for i in range(0, len(terms), SLAB)]
            )
            index = np.array(rows)
            for i, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
                if end > start:
                    parts = range(start, end, ROWS_AT_ONCE)
                    least = [made[index[at : min(end, at + ROWS_AT_ONCE)]].min(0) for at in parts]
                    out[i] = np.minimum.reduce(least) & np.uint64(0xFFFF)
        return [row.tobytes() for row in out]


def likeness(one: bytes, other: bytes) -> float:
    """Share of equal samples."""
    return float((np.frombuffer(one, np.uint16) == np.frombuffer(other, np.uint16)).mean())


PRINT = T.StructType([T.StructField("fingerprint", T.StringType())])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df[keep]`` with the fingerprint of each text."""

    def make():
        sampler = WeightedSampler()

        def work(column):
            texts = [t or b"" for t in texts_of(column)]
            found: list[bytes] = []
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                found += sampler.of(texts[i : i + TEXTS_AT_ONCE])
            return [[f.hex() for f in found]]

        return work

    return add_columns(df, [text], PRINT, make, keep)


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_descending_order(df: DataFrame, id: str, text: str) -> DataFrame:
    """(part, last, id, text): descending ids (nulls last, equal ids by text),
    cut into parts that tasks hold one after another. The first row of a part
    is added, as ``last``, to the end of the part before it, and the first of
    all to the very end, so every row finds its successor in its own part.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS_PER_TASK * tasks
    rows = df.select(df[id].alias("id"), F.coalesce(df[text], F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce(F.col("id").cast("double"), F.lit(float("-inf"))))
    bounds = rows.filter("id IS NOT NULL").approxQuantile("place", [i / parts for i in range(1, parts)], 0.25 / parts)
    bounds = sorted(set(bounds))
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        rows = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(rows)
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    rows = rows.select("id", "text", (F.lit(len(bounds)) - F.col("bucket")).cast("int").alias("part"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    # ids and text hashes alone find the first row of every part: a row each
    order = F.struct(F.col("id").isNull(), -F.col("id"), "digest")
    found = rows.groupBy("part").agg(F.min(order).alias("first")).select("part", "first.*").collect()
    found = sorted(found, key=lambda r: r[0])
    firsts = spark.createDataFrame(
        [(own, None if minus is None else -minus, digest, found[i - 1][0]) for i, (own, _, minus, digest) in enumerate(found)],
        "part int, id long, digest string, before int",
    )
    met = [rows[c].eqNullSafe(firsts[c]) for c in ("part", "id", "digest")]
    guests = F.broadcast(firsts)
    own = F.struct(rows["part"].alias("part"), F.lit(False).alias("last"))
    guest = F.struct(F.col("before").alias("part"), F.lit(True).alias("last"))
    both = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))
    spread = rows.join(guests, met, "left").select(rows["id"], "text", F.inline(both))
    keys = ["part", "last", F.col("id").desc_nulls_last(), F.sha2("text", 256)]
    return spread.repartition(tasks, "part").sortWithinPartitions(*keys).select("part", "last", "id", "text")


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def compared_with_edits(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likeness.

    Rows without an id come last; rows of one id follow each other by a hash
    of their texts. Repeated rows stay, each its own successor's predecessor.
    A single row is its own successor. An empty table gives an empty result.
    """
    ordered = in_descending_order(df, id, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(RESULT)
        sampler = WeightedSampler()

        def finish(rows: list[tuple], n: int) -> pa.RecordBatch:
            """The first n rows, each with a successor among ``rows``."""
            changed = [edited(rows[i][3], rows[i + 1][3]).encode() for i in range(n)]
            prints = sampler.of([r[3].encode() for r in rows] + changed)
            out = []
            for i in range(n):
                own, next_, edit = prints[i], prints[i + 1], prints[len(rows) + i]
                out.append(
                    (
                        rows[i][2], len(rows[i][3]), hashlib.sha256(changed[i]).hexdigest(), own.hex(), edit.hex(),
                        likeness(own, edit), likeness(own, next_),
                    )
                )
            return emit(arrow.names, arrow.types, out)

        held: list[tuple] = []
        seen: set[tuple] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1]:  # the successor of the part's last row; its copies are no rows
                    if (row[0], True) not in seen:
                        seen.add((row[0], True))
                        if held:
                            yield finish([*held, row], len(held))
                    held = []
                    continue
                if held and held[-1][0] != row[0]:
                    raise RuntimeError("a part ended without the row that follows it")
                held.append(row)
                if len(held) > TEXTS_AT_ONCE:
                    yield finish(held, len(held) - 1)
                    held = held[-1:]

    return ordered.mapInArrow(work, RESULT)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
