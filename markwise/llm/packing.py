"""Packing of token sequences by non-negative least squares.

Every document is its token ids and an end id. Whole windows of a document are
sequences by themselves; what remains of it has a length below the window. The
counts of those lengths (at most ``window`` numbers, whatever the corpus) go
to the driver. There, combinations of two or three lengths that exactly fill a
window are the columns of a non-negative least-squares problem against the
counts; its solution, rounded down, says how often each combination is used,
and a greedy pass uses up combinations that still fit. The rest is packed
greedily, longest first, one behind the other, and cut where a window is full.
The last, partly filled window is cut into sequences of powers of two, so no
sequence needs padding.

A document finds its place without a global order: tasks number the documents
of each length as they encode them, the counts per task give the first number
of each task, and the plan maps numbers to places.

A null or empty text is one piece with the end id alone. Rows are packed as
they are, repeated ones and null ids too. The literal names of special tokens
in a text are ordinary text. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import ROWS_OUT, add_columns, emit, stored, table
from markwise.llm.byte_pairs import load
from markwise.llm.chunked_encoding import vocabulary_path
from markwise.session import written

WINDOW = 2048
END = 1
#: Lengths that third members of a combination are taken from.
POPULAR = 48
#: The table of first numbers is broadcast if its counted bytes are within this.
BROADCAST_BYTES = 64 << 20


def fills(counts: np.ndarray, window: int, popular: int = POPULAR) -> np.ndarray:
    """Combinations (a, b, c) of lengths in use with a + b + c = window; c may be 0."""
    used = np.flatnonzero(counts)
    used = used[used > 0]
    pairs = np.stack([used, window - used, np.zeros_like(used)], 1)
    often = used[np.argsort(-counts[used], kind="stable")[:popular]]
    a, b = np.meshgrid(used, often, indexing="ij")
    triples = np.stack([a.ravel(), b.ravel(), window - a.ravel() - b.ravel()], 1)
    found = np.vstack([pairs, triples[triples[:, 2] > 0]])
    found = np.unique(-np.sort(-found, axis=1), axis=0)
    present = (counts[found] > 0) | ((found == 0) & (np.arange(3) == 2))
    return found[present.all(1)]


def least_squares(columns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that brings sum of x times columns close to counts.

    Multiplicative steps keep x non-negative and never raise the squared
    error; a column is a combination, one in each of its lengths.
    """
    goal = counts.astype(float)
    goal[0] = 0
    width = len(goal)

    def spread(x):
        made = np.bincount(columns.ravel(), np.repeat(x, columns.shape[1]), width)
        made[0] = 0
        return made

    pull = goal[columns].sum(1)
    x = np.full(len(columns), goal.sum() / max(1, 3 * len(columns)))
    for _ in range(rounds):
        x = x * pull / np.maximum(spread(x)[columns].sum(1), 1e-12)
    return x


def repeats(columns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): the rounded solution, then whatever still fits, within the counts."""
    left = counts.copy()
    order = np.argsort(-x, kind="stable")
    total: dict[tuple[int, ...], int] = defaultdict(int)
    for take in (np.floor(x), np.full(len(x), np.inf)):
        for k in order[take[order] >= 1]:
            lengths = tuple(int(v) for v in columns[k] if v)
            times = min(left[v] // lengths.count(v) for v in lengths)
            times = int(min(times, take[k]))
            if times > 0:
                total[lengths] += times
                for v in lengths:
                    left[v] -= times
    return list(total.items())


@dataclass
class Plan:
    """Where the numbered documents of each length go.

    ``runs[length]`` are rows (first number, first sequence, offset) of
    combinations, ``streams[length]`` is (first number, place in the stream).
    """

    window: int
    runs: dict[int, np.ndarray]
    streams: dict[int, tuple[int, int]]
    first_stream: int
    stream_tokens: int
    sequences: int

    def cuts(self) -> list[int]:
        """Ends of the sequences that the last window of the stream is cut into."""
        rest, at, ends = self.stream_tokens % self.window, self.stream_tokens // self.window * self.window, []
        for bit in range(self.window.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                at += 1 << bit
                ends.append(at)
        return ends

    def places(self, length: int, number: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of a document's remainder."""
        first, base = self.streams.get(length, (None, 0))
        if first is None or number < first:
            runs = self.runs[length]
            run = runs[np.searchsorted(runs[:, 0], number, side="right") - 1]
            return [(length, int(run[1] + number - run[0]), int(run[2]))]
        at = base + (number - first) * length
        out = []
        whole = self.stream_tokens // self.window
        tail = self.tail
        while length:
            if at < whole * self.window:
                sequence, start = divmod(at, self.window)
                start, end = at - start, at - start + self.window
            else:
                k = next(i for i, e in enumerate(tail) if at < e)
                sequence, start, end = whole + k, ([whole * self.window] + tail)[k], tail[k]
            piece = min(length, end - at)
            out.append((piece, self.first_stream + sequence, at - start))
            at, length = at + piece, length - piece
        return out

    def __post_init__(self):
        self.tail = self.cuts()


def plan_windows(counts: np.ndarray, window: int) -> Plan:
    columns = fills(counts, window)
    chosen = repeats(columns, least_squares(columns, counts), counts) if len(columns) else []
    next_number = np.zeros(window, np.int64)
    runs: dict[int, list] = defaultdict(list)
    sequence = 0
    for lengths, times in chosen:
        offset = 0
        for v in lengths:
            runs[v].append((next_number[v], sequence, offset))
            next_number[v] += times
            offset += v
        sequence += times
    streams, at = {}, 0
    for v in range(window - 1, 0, -1):
        rest = int(counts[v] - next_number[v])
        if rest:
            streams[v] = (int(next_number[v]), at)
            at += rest * v
    plan = Plan(window, {v: np.array(r, np.int64) for v, r in runs.items()}, streams, sequence, at, 0)
    plan.sequences = sequence + at // window + len(plan.tail)
    return plan


ENCODED = T.StructType(
    [
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("task", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("window_place", T.LongType()),
    ]
)


def encoded(df: DataFrame, path: str, window: int, text: str, keep: list[str]) -> DataFrame:
    """Written: ids with the end id, and running numbers within the task."""

    def make():
        pairs, task = load(path), TaskContext.get().partitionId()
        seen, windows = defaultdict(int), 0

        def work(column):
            nonlocal windows
            rows = []
            for t in column.to_pylist():
                ids = np.append(pairs.encode_array(t or ""), np.uint32(END)).astype("<u4")
                whole, length = divmod(len(ids), window)
                rows.append((len(ids), ids.tobytes(), task, length, seen[length], windows))
                seen[length] += 1
                windows += whole
            return list(zip(*rows, strict=True)) if rows else [[] for _ in ENCODED]

        return work

    return stored(add_columns(df, [text], ENCODED, make, keep), "tokens")


def pack(
    df: DataFrame,
    path: str,
    text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    with_ids: bool = True,
) -> DataFrame:
    """A row per piece: ``df[keep]``, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the piece's ids (little-endian 32-bit, binary)."""
    spark = df.sparkSession
    keep = df.columns if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    tokens = encoded(
        df.select(*[df[c].alias(n) for c, n in zip(keep, names, strict=True)], df[text].alias("text")),
        path, window, "text", names,
    )
    # length 0 counts the whole windows of a task, the others its documents
    sizes = tokens.select(
        "task", F.inline(F.array(
            F.struct("length", F.when(F.col("length") > 0, 1).otherwise(0).cast("long").alias("n")),
            F.struct(F.lit(0).cast("long").alias("length"), F.expr(f"doc_tokens div {window}").alias("n")),
        )),
    ).groupBy("length", "task").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "firsts")
    counts = np.zeros(window, np.int64)
    n_firsts = 0
    for row in firsts.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
        counts[row["length"]] = row["n"]
        n_firsts += row["rows"]
    plan = plan_windows(np.where(np.arange(window) > 0, counts, 0), window)
    shared = spark.sparkContext.broadcast(plan)

    starts = firsts.select("length", "task", "first")
    windows = firsts.filter("length = 0").select("task", F.col("first").alias("window_first"))
    if n_firsts * 24 <= BROADCAST_BYTES:
        starts, windows = F.broadcast(starts), F.broadcast(windows)
    numbered = tokens.join(starts, ["length", "task"]).join(windows, "task").select(
        *names, "doc_tokens", "ids", "length",
        (F.col("first") + F.col("place")).alias("number"),
        (F.col("window_first") + F.col("window_place")).alias("window_number"),
    )
    made = T.StructType(
        [tokens.schema[n] for n in names]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(made)
        plan = shared.value
        for batch in batches:
            rows = []
            kept = [batch.column(i).to_pylist() for i in range(len(names))]
            numbers = [c.to_pylist() for c in batch.columns[len(names) + 1 :]]
            doc_tokens = batch.column(len(names)).to_pylist()
            ids_column, lengths, order, first_window = numbers
            for i, ids in enumerate(ids_column):
                own = tuple(k[i] for k in kept)
                whole = doc_tokens[i] // plan.window
                pieces = [(plan.window, plan.sequences + first_window[i] + w, 0) for w in range(whole)]
                if lengths[i]:
                    pieces += plan.places(lengths[i], order[i])
                start = 0
                for length, sequence, offset in pieces:
                    part = ids[4 * start : 4 * (start + length)]
                    row = (*own, start, length, zlib.crc32(part), doc_tokens[i], sequence, offset)
                    rows.append((*row, part) if with_ids else row)
                    start += length
                if len(rows) >= ROWS_OUT:
                    yield emit(arrow.names, arrow.types, rows)
                    rows = []
            yield emit(arrow.names, arrow.types, rows)

    pieces = numbered.mapInArrow(cut, made)
    rest = [f.name for f in made][len(names) :]
    return pieces.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True) if c not in rest], *rest)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(documents, vocabulary_path("byte_bpe_50k.json"), keep=["doc_id"], with_ids=False)
