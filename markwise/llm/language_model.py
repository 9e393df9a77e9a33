"""Language-model scores of documents, learned from the training documents.

Documents are packed into blocks: the distinct words of a block as hashes, and
its texts as numbers of those words. From then on work is done on numbers.

1. Every block asks for the corpus counts of its words. Its words are cut by
   hash range; a task holds one range of all blocks, adds the counts up, and
   answers each block. No word, however frequent, sends more than one number
   per block, and the number of ranges grows with the counted tokens.
2. Words and n-grams that occur ``LEAST`` times in the training texts are the
   model's own, however large the corpus. Order by order every block asks for
   the counts of its n-grams in the same way, by ranges of their hashes, if
   the parts of the n-gram are kept. One of the blocks that hold a kept n-gram
   is told that it owns it.
3. A history's failure arc needs sums over all its kept followers. The blocks
   add up the n-grams they own and ask for the sums of their histories, by the
   numbers that came with the counts and take fewer bits than hashes; a history,
   however frequent, sends one row of numbers per block. No task and no driver holds the model, and it grows with the corpus.
4. Every block then knows all arcs its texts can take. It lays them out as a
   weighted automaton with failure arcs (``backoff_automaton``) and walks it once
   over each text, carrying the state.

Blocks and the answers to them lie in tables bucketed by block, so an answer is
shuffled once and a text never.

Base scores, and the bottom of the model, are unigram probabilities with one
half added to each count and one class for unknown words.

Defined results: null, empty and blank texts are their end token alone. A row
without an id is not held out. Repeated rows count and are scored as rows. With
no training text every token has probability 1 in base and model. Words are told
apart by 64-bit hashes, n-grams by as many bits as the corpus has training
tokens and ``SPARE_BITS`` more, so the share of mistaken ones is alike at every
size. A very long text is a block of its own, held whole by one task. A column
of any name besides id and text does no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.backoff_automaton import Automaton, automaton
from markwise.llm.batches import emit, table, texts_of
from markwise.llm.words import WordHashes, mixed
from markwise.session import fresh_path

#: Kept are words and n-grams that occur so often in the training texts.
LEAST = 2
#: Least shares of the training tokens that words and n-grams need besides; none,
#: as a share would drop more of the model the larger the corpus is.
FREQUENT, KEPT = 0.0, 0.0
ORDER, DISCOUNT = 3, 0.75
BLOCK_TOKENS, BLOCK_DOCUMENTS = 400_000, 4000
#: Keys that a task gathers before it passes them on.
CODES_AT_ONCE = 500_000
#: Training tokens per range of hashes, about; more tokens make more ranges.
RANGE_TOKENS = 4_000_000
#: Whether the shuffle files behind a table go once it is written.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of an n-gram's hash beyond those that number the training tokens.
SPARE_BITS = 24
#: Numbers of histories lie so far apart that their orders have room, and the beginning of a text has the last one.
ORDERS, BEGIN_NUMBER = 8, np.uint64(2**64 - 1)
#: Stand for the end and the beginning of a text; no word holds a line break.
END_MARK, BEGIN_MARK = b"\n", b"\n\n"

BLOCKS = (
    "block long, ids array<long>, held array<boolean>, lengths binary, tokens binary, "
    "words binary, counts binary, train_tokens long, train_texts long"
)


def packed(numbers: np.ndarray) -> bytes:
    """Integers by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(numbers.reshape(-1, 1).view(np.uint8).T).tobytes()
    return struct.pack("<I", len(planes)) + pa.Codec("zstd").compress(planes, asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(data[4:], struct.unpack("<I", data[:4])[0], asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """Like ``stored``, bucketed by block, so that joins on it shuffle nothing.

    The catalog is told of the table only to have it read with its buckets.
    """
    spark = df.sparkSession
    known = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.write.option("compression", "zstd").option("path", fresh_path(spark, name)).format("parquet")
    before = spark.conf.get(LET_GO)
    spark.conf.set(LET_GO, "true")
    try:
        rows.bucketBy(buckets, "block").sortBy("block").saveAsTable(known)
    finally:
        spark.conf.set(LET_GO, before)
    found = spark.table(known)
    spark.sql(f"DROP TABLE {known}")
    return found


def blocks_of(df: DataFrame, id: str, text: str) -> DataFrame:
    """Stored blocks: sorted word hashes (words), their counts in training texts
    (counts), and the texts one behind the other as places in words (tokens)."""
    sent = df.select(df[id].alias("id"), held_out_column(df, id).alias("held"), df[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task = WordHashes(), TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
        names = ["block", "ids", "held", "lengths", "tokens", "words", "counts", "train_tokens", "train_texts"]
        made = 0
        number: dict[bytes, int] = {}
        ids, held, tokens, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal made, size
            lengths = np.array([len(t) for t in tokens], np.uint32)
            order, place = np.unique(hashes.of(list(number)), return_inverse=True)
            flat = place[np.concatenate(tokens)].astype(np.uint32)
            train = ~np.repeat(np.array(held), lengths)
            counts = np.bincount(flat[train], minlength=len(order)).astype(np.int64)
            row = (
                task << 32 | made, list(ids), list(held), packed(lengths), packed(flat), packed_keys(order),
                packed(counts), int(counts.sum()), len(held) - sum(held),
            )
            made, size = made + 1, 0
            for part in (number, ids, held, tokens):
                part.clear()
            return emit(names, kinds, [row])

        for batch in batches:
            columns = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True)
            for own, out, content in columns:
                words = (content or b"").lower().split()
                words.append(END_MARK)
                add = number.setdefault
                tokens.append(np.fromiter((add(w, len(number)) for w in words), np.uint32, len(words)))
                ids.append(own)
                held.append(out)
                size += len(words)
                if size >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCUMENTS:
                    yield block()
        if ids:
            yield block()

    return bucketed(sent.mapInArrow(run, BLOCKS), "blocks")


def held_out_column(df: DataFrame, id: str):
    return F.coalesce(F.crc32(df[id].cast("string").cast("binary")) % 5 == 1, F.lit(False))


def exchanged(
    rows: DataFrame,
    ask: Callable[[dict], tuple[np.ndarray, np.ndarray]],
    parts: int,
    least: float = 0.0,
    unsent: int = 0,
    owners: bool = True,
    numbered: float | None = None,
) -> DataFrame:
    """Written answers (block, totals, distinct) to what ``ask`` makes of each row.

    ``ask`` gives sorted keys and a matrix of numbers, a column per key. The
    answers of a block, by range of hashes (``parts`` of them) one behind the
    other, are the sums of the numbers over all blocks and, with ``owners``, in a
    row whether the block owns the key; all are 0 where the first sum is below
    ``least``. With ``numbered``, a last row numbers the keys whose first sum is
    not below it, by steps: a range counts on from its first key, so numbers are
    keys that lie close together. A row without a block holds the number of keys whose
    first sum is not 0. The last ``unsent`` bits of a key stay with the block.
    """
    bounds = (np.arange(1, parts, dtype=object) * 2**64 // parts).astype(np.uint64)
    starts = np.append(np.uint64(0), bounds)
    at_once, low = CODES_AT_ONCE, np.uint64(unsent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["part", "block", "keys", "numbers"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        out, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, numbers = ask(row)
                ends = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                for part, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    if b > a:
                        out.append((part, row["block"], packed_keys(keys[a:b] >> low), packed(numbers[:, a:b])))
                size += len(keys)
                if size >= at_once:
                    yield emit(names, kinds, out)
                    out, size = [], 0
        yield emit(names, kinds, out)

    def answer(asked: pa.Table) -> pa.Table:
        part = asked.column("part")[0].as_py()
        keys = [unpacked_keys(k) for k in asked.column("keys").to_pylist()]
        numbers = [unpacked(n, np.int64).reshape(-1, len(k)) for n, k in zip(asked.column("numbers").to_pylist(), keys, strict=True)]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        known, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        numbers = np.concatenate(numbers, axis=1)
        total = np.stack([np.bincount(place, row, len(known)) for row in numbers]).astype(np.int64)
        total[:, total[0] < least] = 0
        told = [total[:, place]]
        if owners:
            owned = np.zeros(len(place), np.int64)
            owned[first] = total[0] >= max(least, 1)
            told.append(owned)
        answers = np.split(np.vstack(told), ends, axis=1)
        if numbered is not None:
            kept = total[0] >= numbered
            number = starts[part] + np.cumsum(kept).astype(np.uint64) * np.uint64(ORDERS)
            for i, own in enumerate(np.split(place, ends)):
                steps, mine = np.zeros(len(own), np.uint64), kept[own]
                steps[mine] = np.diff(number[own[mine]], prepend=np.uint64(0))
                answers[i] = np.vstack([answers[i], steps.view(np.int64)])
        return pa.table(
            {
                "block": pa.array([*asked.column("block").to_pylist(), None], pa.int64()),
                "part": pa.array([part] * (len(keys) + 1), pa.int64()),
                "totals": pa.array([*map(packed, answers), None], pa.binary()),
                "distinct": pa.array([*[0] * len(keys), int((total[0] > 0).sum())], pa.int64()),
            }
        )

    asked = rows.mapInArrow(cut, "part long, block long, keys binary, numbers binary")
    given = asked.groupBy("part").applyInArrow(answer, "block long, part long, totals binary, distinct long")
    in_order = F.array_sort(F.collect_list(F.struct("part", "totals")))
    by_block = given.groupBy("block").agg(
        F.transform(in_order, lambda a: a["totals"]).alias("totals"), F.sum("distinct").alias("distinct")
    )
    return bucketed(by_block, "answers")


def with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """The blocks with the answers to them (null: none), ``a0``, ``a1`` and so on."""
    for i, given in enumerate(answers):
        blocks = blocks.join(given.select("block", F.col("totals").alias(f"a{i}")), "block", "left")
    return blocks


def totals_in(answers: list[bytes] | None, height: int) -> np.ndarray:
    """The matrix of a block's answers."""
    found = [unpacked(a, np.int64).reshape(height, -1) for a in answers or ()]
    return np.concatenate(found, axis=1) if found else np.zeros((height, 0), np.int64)


def numbers_in(answers: list[bytes] | None, height: int) -> np.ndarray:
    """The numbers in a block's answers, the last of their rows; of keys without one, any."""
    found = [np.cumsum(unpacked(a, np.int64).reshape(height, -1)[-1].view(np.uint64)) for a in answers or ()]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class Grams:
    """The kept n-grams of a block.

    ``line`` are the block's texts with a begin before each. Of every order
    ``at`` numbers the n-grams that end at each place of the line (-1: one of
    its parts is not kept), ``keys`` are their sorted hashes, ``first`` the
    numbers of their first parts, ``rest`` of their last ones, ``n`` their
    counts in the corpus (0: not kept) and ``owned`` tells which are the block's.
    Below the last order ``number`` are their numbers in the corpus, for the kept ones.
    """

    def __init__(self, row: dict, texts: int, least: float):
        self.held = np.array(row["held"], bool)
        self.lengths = unpacked(row["lengths"], np.uint32).astype(np.int64)
        tokens, words = unpacked(row["tokens"], np.uint32).astype(np.int64), unpacked_keys(row["words"])
        self.begin = len(words)
        self.hashes = np.append(words, np.uint64(WordHashes()[BEGIN_MARK]))
        starts = np.cumsum(self.lengths) - self.lengths
        self.line = np.insert(tokens, starts, self.begin)
        self.train = np.repeat(~self.held, self.lengths + 1)
        self.corpus = totals_in(row["a0"], 2)[0]
        self.number = [np.append(numbers_in(row["a0"], 2), BEGIN_NUMBER)]
        n = np.append(np.where(self.corpus >= least, self.corpus, 0), texts)
        own = np.append(self.corpus >= least, True)
        self.at = [np.where(own[self.line], self.line, -1)]
        self.keys, self.n, self.owned = [self.hashes], [n], [None]
        self.first, self.rest = [None], [None]

    def next_order(self) -> None:
        """Numbers the n-grams of the next order."""
        at, n = self.at[-1], self.n[-1]
        kept = (at >= 0) & ((n[at] > 0) if len(n) else False)
        inside = np.append(False, kept[:-1] & kept[1:] & (self.line[1:] != self.begin))
        ends = np.flatnonzero(inside)
        width = len(self.hashes)
        codes, back = np.unique(at[ends - 1] * width + self.line[ends], return_inverse=True)
        first, last = codes // width, codes % width
        keys = mixed(mixed(self.keys[-1][first]) + self.hashes[last])
        order = np.argsort(keys)
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        found = np.full(len(self.line), -1)
        found[ends] = number[back]
        rest = np.empty(len(order), np.int64)
        rest[found[ends]] = at[ends]
        self.at.append(found)
        self.keys.append(keys[order])
        self.first.append(first[order])
        self.rest.append(rest)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """What a block asks about its n-grams of the last order: keys, training counts."""
        at = self.at[-1][self.train]
        return self.keys[-1], np.bincount(at[at >= 0], minlength=len(self.keys[-1])).astype(np.int64)[None, :]

    def answered(self, answers: list[bytes] | None, numbered: bool) -> None:
        height = 3 if numbered else 2
        total, owned = totals_in(answers, height)[:2]
        self.n.append(total)
        self.owned.append(owned > 0)
        if numbered:
            self.number.append(numbers_in(answers, height))

    def histories(self) -> list[np.ndarray]:
        """The kept n-grams of each order below the last, by their numbers."""
        return [np.flatnonzero(n > 0) for n in self.n[:-1]]

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the histories in order; their owned followers' number, counts,
        and counts of the followers without the history's first word; and that order."""
        keys, sums = [], []
        for m, own in enumerate(self.histories(), 1):
            mine = np.flatnonzero(self.owned[m])
            numbers = np.ones(len(mine)), self.n[m][mine], self.n[m - 1][self.rest[m][mine]]
            added = [np.bincount(self.first[m][mine], x, len(self.n[m - 1]))[own] for x in numbers]
            keys.append(self.number[m - 1][own] + np.uint64(m - 1))
            sums.append(np.stack(added).astype(np.int64))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate(sums, axis=1)[:, order], order

    def automaton(self, answers: list[bytes] | None, norm: float, discount: float) -> Automaton:
        """What the block's texts can reach of the model.

        States are the histories that kept n-grams follow. Counts of followers
        are lowered by ``discount``; what is left over goes to the failure arc,
        so the probabilities behind a history sum to 1.
        """
        _, _, order = self.sums()
        total = np.empty((3, len(order)), np.int64)
        total[:, order] = totals_in(answers, 3)
        width, done, made = len(self.hashes), 0, 1
        state: list[np.ndarray] = []  # of each n-gram; 0 where nothing follows it
        fail, backoff = [np.zeros(1, np.int64)], [np.zeros(1)]
        for m, own in enumerate(self.histories(), 1):
            k, followed, lower = total[:, done : done + len(own)]
            done += len(own)
            used = k > 0
            history, k, followed, lower = own[used], k[used], followed[used], lower[used]
            number = np.zeros(len(self.n[m - 1]) + 1, np.int64)
            number[history] = made + np.arange(len(history))
            n = self.n[m - 1][history]
            left = (n - followed + discount * k) / n
            if m == 1:
                fail.append(np.zeros(len(history), np.int64))
                below = 1 - (lower + 0.5 * k) / norm
            else:
                suffix = self.rest[m - 1][history]
                fail.append(state[-1][suffix])
                shorter = self.n[m - 2][suffix]
                below = (shorter - lower + discount * k) / shorter
            backoff.append(np.log10(np.maximum(left, 1e-12) / np.maximum(below, 1e-12)))
            state.append(number)
            made += len(history)
        codes, weights, targets = [], [], []
        last = np.arange(width)  # the last word of each n-gram
        behind = state[0][:width]  # the state of its longest suffix that is one
        for m in range(1, len(self.n)):
            suffix = self.rest[m]
            last, behind = last[suffix], behind[suffix]
            if m < len(state):
                behind = np.where(state[m][:-1] > 0, state[m][:-1], behind)
            kept = np.flatnonzero(self.n[m] > 0)
            first = self.first[m][kept]
            codes.append(state[m - 1][first] * width + last[kept])
            weights.append(np.log10((self.n[m][kept] - discount) / self.n[m - 1][first]))
            targets.append(behind[kept])
        arcs = (np.concatenate(part) for part in (codes, weights, targets))
        start, reach = state[0][:width], len(self.n) - 1
        return automaton(width, *arcs, np.concatenate(fail), np.concatenate(backoff), start, reach, self.begin)

    def scores(self, answers: list[bytes] | None, alone: np.ndarray, norm: float, discount: float) -> np.ndarray:
        """log10 probability of each text; ``alone`` are those of the tokens by the unigram base."""
        model = self.automaton(answers, norm, discount)
        own = self.at[0] >= 0
        own &= (self.n[0] > 0)[self.at[0]] if len(self.n[0]) else own
        here = self.line != self.begin
        base = np.zeros(len(self.line))
        base[here] = alone
        gains = model.walk(np.where(own | ~here, self.line, -1), base)
        return np.add.reduceat(gains[here], np.cumsum(self.lengths) - self.lengths)


def spelt(codes: np.ndarray, width: int, kept: list[np.ndarray]) -> np.ndarray:
    """The tokens of n-gram codes, a row each."""
    last, first = codes % width, codes // width
    if not kept:
        return np.stack([first, last], 1)
    return np.column_stack([spelt(kept[-1][first], width, kept[:-1]), last])


SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def score_documents(df: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    blocks = blocks_of(df, id, text)
    sums = blocks.agg(F.sum("train_tokens").alias("tokens"), F.sum("train_texts").alias("texts")).first()
    total, texts = sums["tokens"] or 0, sums["texts"] or 0
    least_words, least_grams = max(LEAST, total * FREQUENT), max(LEAST, total * KEPT)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_TOKENS)
    unsent = max(0, 64 - SPARE_BITS - total.bit_length())
    asked = blocks.select("block", "words", "counts")
    ask_words = lambda row: (unpacked_keys(row["words"]), unpacked(row["counts"], np.int64)[None, :])
    answers = [exchanged(asked, ask_words, parts, owners=False, numbered=least_words)]
    distinct = answers[0].filter("block IS NULL").agg(F.sum("distinct")).first()[0] or 0
    norm = total + 0.5 * (distinct + 1)
    texts_only = blocks.select("block", "held", "lengths", "tokens", "words")

    def grams_of(row: dict, orders: int) -> Grams:
        grams = Grams(row, texts, least_words)
        for m in range(1, orders):
            grams.next_order()
            grams.answered(row[f"a{m}"], m < order - 1)
        return grams

    def ask_for(orders: int):
        def ask(row: dict) -> tuple[np.ndarray, np.ndarray]:
            grams = grams_of(row, orders)
            grams.next_order()
            return grams.counted()

        return ask

    for orders in range(1, order):
        numbered = least_grams if orders < order - 1 else None
        answers.append(exchanged(with_answers(texts_only, answers), ask_for(orders), parts, least_grams, unsent, numbered=numbered))
    answers.append(exchanged(with_answers(texts_only, answers), lambda row: grams_of(row, order).sums()[:2], parts, owners=False))
    asked = with_answers(blocks.select("block", "ids", "held", "lengths", "tokens", "words"), answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(SCORED)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = grams_of(row, order)
                tokens = grams.line[grams.line != grams.begin]
                alone = np.log10((grams.corpus + 0.5) / norm)[tokens]
                score = grams.scores(row[f"a{order}"], alone, norm, DISCOUNT)
                lengths = grams.lengths
                starts = np.cumsum(lengths) - lengths
                base = np.add.reduceat(alone, starts)
                known = np.add.reduceat((grams.corpus > 0)[tokens].astype(np.int64), starts)
                columns = [row["ids"], row["held"], lengths, known, np.full(len(lengths), total), base, score]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], names=arrow.names
                )

    return asked.mapInArrow(run, SCORED)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
