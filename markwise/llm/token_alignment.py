"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked ids.

A text is tokenised by a byte-level vocabulary (A) and by pieces (B). Byte
offsets where a token of each ends cut both sequences into groups, and the two
tokens that end there are linked. How often each pair of ids is linked in the
whole corpus says how usual a link is.

The first pass writes the ids of both sides. Distinct pairs, found per task and
made distinct by Spark, are dealt by their B id into shards, and every shard
gets a minimal perfect hash with its keys in the order of their numbers. Then
documents are aligned again: every task counts links into one dense vector
indexed by the hash; pieces of the vectors are summed per segment in a tree of
two levels, each sum holding one segment at a time. The last pass aligns once
more and looks the counts up; a key that is not at its number is not in the
shard.

Shards go to the tasks as many at a time as ``broadcast_bytes`` allow, by their
counted keys. Where all pairs do not fit at once, the documents pass by once
per part and carry their sums along; all pairs of a B id are in one shard.

Defined results: texts that are null or empty, or that the tokens of A or B do
not spell byte by byte with a space before them (B folds some characters), have
no tokens: zeros and an empty digest. Strings of special tokens in a text are
ordinary text. Rows are taken as they are, so a repeated row's links count
again, and ids may be null. An empty table gives an empty result. A column with
the name of an output column gives way to it. A text is tokenised whole, in
memory of about 40 bytes a token.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, emit, stored, table
from markwise.llm.byte_pairs import BytePairs, load
from markwise.llm.chunked_encoding import vocabulary_path
from markwise.llm.perfect_hash import PerfectHash
from markwise.session import written

#: Keys of a shard, beyond which the next B id begins another.
SHARD_KEYS = 1 << 20
#: Slots of a segment of the count vectors.
SEGMENT = 1 << 16
#: Branches of the lower level of the tree of sums.
BRANCHES = 32
#: Keys, counts and hashes that tasks hold at a time, at BYTES_PER_KEY a key.
BROADCAST_BYTES, BYTES_PER_KEY = 128 << 20, 24
#: Distinct pairs that a task holds before it passes them on.
PAIRS_HELD = 1 << 20
#: Characters that are tokenised, and bytes of packed ids that are aligned, at a time.
AT_ONCE = 1 << 20


class Pieces:
    """The vocabulary of side B: pieces with a mark for the space, or single bytes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.vocabulary = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)])
            if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode()
            for i in ids
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


def lengths(vocabulary: list[bytes]) -> np.ndarray:
    return np.array([len(token) for token in vocabulary], np.int64)


def slices(items: list, bound: int) -> Iterator[list]:
    """The items in runs whose lengths reach ``bound`` with the last one only."""
    some, held = [], 0
    for item in items:
        some.append(item)
        held += len(item)
        if held >= bound:
            yield some
            some, held = [], 0
    if some:
        yield some


def kinds_of(a: BytePairs, b: Pieces) -> tuple[str, str]:
    """The numbers that the ids of each side are packed in, of 16 or 32 bits, little-endian."""
    one, other = ("<u2" if len(side.vocabulary) <= 1 << 16 else "<u4" for side in (a, b))
    return one, other


def tokens_of(texts: list[str | None], a: BytePairs, b: Pieces) -> list[tuple[bytes, bytes]]:
    """Packed ids of both sides per text. Those of A always spell the text; B's may not."""
    found = []
    kind_a, kind_b = kinds_of(a, b)
    for some in slices([t or "" for t in texts], AT_ONCE):
        for text, ids_b in zip(some, b.encode(some), strict=True):
            spelt = f" {text}"
            if text and b.decode(ids_b) == spelt.encode():
                found.append((a.encode_array(spelt).astype(kind_a).tobytes(), np.array(ids_b, kind_b).tobytes()))
            else:
                found.append((b"", b""))
    return found


@dataclass
class Alignment:
    """Tokens of both sides and, per token, whether a token of the other side ends with it."""

    a: np.ndarray
    b: np.ndarray
    shared_a: np.ndarray
    shared_b: np.ndarray

    def keys(self) -> np.ndarray:
        """The linked pairs, in order: B id in the upper half, A id in the lower."""
        return self.b[self.shared_b].astype(np.uint64) << np.uint64(32) | self.a[self.shared_a]


class Aligner:
    """Aligns packed ids by the lengths of their tokens in bytes."""

    def __init__(self, path_a: str, path_b: str):
        a, b = load(path_a), load_pieces(path_b)
        self.kinds = kinds_of(a, b)
        self.sizes = len(a.vocabulary), len(b.vocabulary)
        self.length_a, self.length_b = lengths(a.vocabulary), lengths(b.vocabulary)

    def align(self, ids_a: bytes, ids_b: bytes) -> Alignment:
        a, b = np.frombuffer(ids_a, self.kinds[0]), np.frombuffer(ids_b, self.kinds[1])
        if not len(a):
            none = np.zeros(0, bool)
            return Alignment(a, b, none, none)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        place = np.searchsorted(end_b, end_a)
        shared_a = end_b[np.minimum(place, len(b) - 1)] == end_a
        shared_b = np.zeros(len(b), bool)
        shared_b[place[shared_a]] = True
        return Alignment(a, b, shared_a, shared_b)


class Writer:
    """Groups written as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        # of one width, filled up with zero bytes
        self.spelt = np.array(
            [f"{i}{mark}".encode() for n, last in ((n_a, "|"), (n_b, ";")) for i in range(n) for mark in (",", last)]
        )

    def write(self, found: Alignment) -> bytes:
        if not len(found.a):
            return b""
        group_a = np.cumsum(found.shared_a) - found.shared_a
        group_b = np.cumsum(found.shared_b) - found.shared_b
        ends_a, ends_b = np.flatnonzero(found.shared_a) + 1, np.flatnonzero(found.shared_b) + 1
        codes = np.empty(len(found.a) + len(found.b), np.int64)
        codes[np.arange(len(found.a)) + np.append(0, ends_b)[group_a]] = 2 * found.a.astype(np.int64) + found.shared_a
        codes[np.arange(len(found.b)) + ends_a[group_b]] = 2 * (self.n_a + found.b.astype(np.int64)) + found.shared_b
        return self.spelt[codes].tobytes().translate(None, b"\0")[:-1]


IDS = T.StructType([T.StructField("ids_a", T.BinaryType()), T.StructField("ids_b", T.BinaryType())])


def tokenised(df: DataFrame, path_a: str, path_b: str, text: str, keep: list[str]) -> DataFrame:
    """Written: ``df[keep]`` with the ids of both sides."""

    def make():
        a, b = load(path_a), load_pieces(path_b)

        def work(column):
            rows = tokens_of(column.to_pylist(), a, b)
            return list(zip(*rows, strict=True)) if rows else [[], []]

        return work

    return stored(add_columns(df, [text], IDS, make, keep), "tokens")


def alignments(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[list[Alignment]]:
    aligner = Aligner(path_a, path_b)
    for batch in batches:
        ones, others = batch.column("ids_a").to_pylist(), batch.column("ids_b").to_pylist()
        at = 0
        for some in slices(ones, AT_ONCE):
            sides = zip(some, others[at : at + len(some)], strict=True)
            yield [aligner.align(one, other) for one, other in sides]
            at += len(some)


def linked_keys(found: list[Alignment]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a batch and how often each is linked."""
    keys = [alignment.keys() for alignment in found]
    return np.unique(np.concatenate(keys) if keys else np.empty(0, np.uint64), return_counts=True)


def distinct_pairs(tokens: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Written (key): every pair of ids that is linked anywhere."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.uint64)
        for found in alignments(batches, path_a, path_b):
            held = np.union1d(held, linked_keys(found)[0])
            if len(held) > PAIRS_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], names=["key"])
                held = np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], names=["key"])

    return written(tokens.select("ids_a", "ids_b").mapInArrow(collect, "key long").distinct(), "pairs")


def shard_starts(pairs_per_id: list[tuple[int, int]], shard_keys: int) -> tuple[list[int], list[int]]:
    """First B id and number of keys of every shard, from (B id, keys) in order."""
    starts: list[int] = []
    sizes: list[int] = []
    for number, n in pairs_per_id:
        if not starts or sizes[-1] + n > shard_keys:
            starts.append(number)
            sizes.append(0)
        sizes[-1] += n
    return starts, sizes


def hashed_shards(pairs: DataFrame, starts: list[int]) -> DataFrame:
    """Written (shard, hash, keys): a perfect hash per shard, and its keys by number."""
    bounds = F.array(*[F.lit(s) for s in starts]).cast("array<long>")
    shard = F.size(F.filter(bounds, lambda start: start <= F.shiftright("key", 32))) - 1

    def build(group: pa.Table) -> pa.Table:
        keys = np.sort(group.column("key").to_numpy()).view(np.uint64)
        hash_ = PerfectHash.of(keys)
        ordered = np.empty_like(keys)
        ordered[hash_.numbers(keys)] = keys
        return pa.table(
            {"shard": group.column("shard")[:1], "hash": [hash_.to_bytes()], "keys": [ordered.tobytes()]}
        )

    sent = pairs.select(shard.alias("shard"), "key")
    return written(sent.groupBy("shard").applyInArrow(build, "shard int, hash binary, keys binary"), "hashes")


class Shards:
    """Consecutive shards as one numbering of their keys."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], starts: list[int]):
        self.starts = np.array([starts[shard] for shard, _, _ in rows], np.uint64)
        self.hashes = [PerfectHash.from_bytes(data) for _, data, _ in rows]
        sizes = [hash_.size for hash_ in self.hashes]
        self.offsets = np.cumsum([0, *sizes])
        self.keys = np.concatenate([np.frombuffer(data, "<u8") for _, _, data in rows])

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are not in these shards."""
        owner = np.searchsorted(self.starts, keys >> np.uint64(32), "right") - 1
        found = np.full(len(keys), -1, np.int64)
        for shard, hash_ in enumerate(self.hashes):
            own = np.flatnonzero(owner == shard)
            numbers = hash_.numbers(keys[own])
            found[own] = np.where(numbers >= 0, numbers + self.offsets[shard], -1)
        return np.where((found >= 0) & (self.keys[found] == keys), found, -1)


def summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the ``counts`` of equal keys, one running vector at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [*keys, "counts"], [pa.int64()] * len(keys) + [pa.binary()]
        group, total = None, np.zeros(0, np.int64)
        for batch in batches:
            numbers = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for own, packed in zip(numbers, batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), "<i8")
                if own != group:
                    if group is not None:
                        yield emit(names, types, [(*group, zlib.compress(total.tobytes(), 1))])
                    group, total = own, counts.copy()
                else:
                    total += counts
        if group is not None:
            yield emit(names, types, [(*group, zlib.compress(total.tobytes(), 1))])

    schema = ", ".join(f"{k} long" for k in keys) + ", counts binary"
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema)


def counted(tokens: DataFrame, shards, n_keys: int, path_a: str, path_b: str) -> np.ndarray:
    """How often every key of the shards is linked, by its number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shards.value
        total = np.zeros(-(-n_keys // SEGMENT) * SEGMENT, np.int64)
        for found in alignments(batches, path_a, path_b):
            keys, times = linked_keys(found)
            number = own.numbers(keys)
            total[number[number >= 0]] += times[number >= 0]
        branch = TaskContext.get().partitionId() % BRANCHES
        for segment, counts in enumerate(total.reshape(-1, SEGMENT)):
            if counts.any():
                packed = zlib.compress(counts.tobytes(), 1)
                yield emit(["segment", "branch", "counts"], [pa.int64(), pa.int64(), pa.binary()], [(segment, branch, packed)])

    parts = tokens.select("ids_a", "ids_b").mapInArrow(count, "segment long, branch long, counts binary")
    sums = written(summed(summed(parts, ["segment", "branch"]).drop("branch"), ["segment"]), "counts")
    total = np.zeros(-(-n_keys // SEGMENT) * SEGMENT, np.int64)
    for row in sums.collect():  # as many slots as the shards have keys
        total[row["segment"] * SEGMENT :][:SEGMENT] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return total[:n_keys]


SUMS = T.StructType([T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
OUT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + list(SUMS)
    + [T.StructField("groups_sha256", T.StringType())]
)
OUT_TEXT = T.StructType([*OUT, T.StructField("groups", T.StringType())])


def looked_up(
    tokens: DataFrame, looked, outputs: T.StructType, path_a: str, path_b: str, keep: list[str]
) -> DataFrame:
    """``tokens[keep]`` with the sums so far and, where asked for, the descriptions of the groups."""
    names = [field.name for field in outputs]

    def make():
        aligner = Aligner(path_a, path_b)
        writer = Writer(*aligner.sizes) if "groups_sha256" in names else None
        shards, counts = looked.value if looked else (None, None)
        if shards:
            best = np.zeros(aligner.sizes[1], np.int64)
            np.maximum.at(best, (shards.keys >> np.uint64(32)).astype(np.int64), counts)

        def work(ids_a, ids_b, n_best, count_sum):
            rows = []
            columns = (ids_a, ids_b, n_best, count_sum)
            for one, other, before, sum_before in zip(*[c.to_pylist() for c in columns], strict=True):
                found = aligner.align(one, other)
                row = {"n_best": before, "count_sum": sum_before}
                if shards and len(found.a):
                    keys = found.keys()
                    number = shards.numbers(keys)
                    own = number >= 0
                    held = counts[number[own]]
                    row["n_best"] += int((held == best[(keys[own] >> np.uint64(32)).astype(np.int64)]).sum())
                    row["count_sum"] += int(held.sum())
                if writer:
                    groups = writer.write(found)
                    n = int(found.shared_a.sum())
                    row |= {"n_a": len(found.a), "n_b": len(found.b), "n_groups": n, "n_links": n}
                    row["groups_sha256"] = hashlib.sha256(groups).hexdigest() if groups else ""
                    row["groups"] = groups.decode() if "groups" in names else None
                rows.append(tuple(row[name] for name in names))
            return list(zip(*rows, strict=True)) if rows else [[] for _ in names]

        return work

    return add_columns(tokens, ["ids_a", "ids_b", "n_best", "count_sum"], outputs, make, keep)


def token_alignment(
    df: DataFrame,
    path_a: str,
    path_b: str,
    text: str = "text",
    keep: list[str] | None = None,
    with_groups: bool = True,
    shard_keys: int = SHARD_KEYS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df[keep]`` with the columns ``OUT``, and the groups as text where asked for."""
    spark = df.sparkSession
    keep = [c for c in (df.columns if keep is None else keep) if c not in {f.name for f in OUT_TEXT}]
    names = [f"c{i}" for i in range(len(keep))]
    renamed = df.select(*[df[c].alias(n) for c, n in zip(keep, names, strict=True)], df[text].alias("text"))
    tokens = tokenised(renamed, path_a, path_b, "text", names)
    pairs = distinct_pairs(tokens, path_a, path_b)
    per_id = pairs.groupBy(F.shiftright("key", 32).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # at most as many rows as B has ids
    starts, sizes = shard_starts(sorted((row["b"], row["n"]) for row in per_id.collect()), shard_keys)
    rounds: list[list[int]] = []
    held = 0
    for shard, n in enumerate(sizes):
        if not rounds or (held + n) * BYTES_PER_KEY > broadcast_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += n
    hashes = hashed_shards(pairs, starts) if starts else None
    tokens = tokens.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    outputs = OUT_TEXT if with_groups else OUT
    found = looked_up(tokens, None, outputs, path_a, path_b, names) if not rounds else None
    for number, own in enumerate(rounds):
        rows = hashes.filter(F.col("shard").between(own[0], own[-1])).orderBy("shard").collect()
        shards = Shards([(row["shard"], bytes(row["hash"]), bytes(row["keys"])) for row in rows], starts)
        counts = counted(tokens, spark.sparkContext.broadcast(shards), len(shards.keys), path_a, path_b)
        looked = spark.sparkContext.broadcast((shards, counts))
        if number + 1 < len(rounds):
            carried = looked_up(tokens, looked, SUMS, path_a, path_b, [*names, "ids_a", "ids_b"])
            tokens = stored(carried, "tokens")
        else:
            found = looked_up(tokens, looked, outputs, path_a, path_b, names)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[f.name for f in outputs])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    return token_alignment(documents, *paths, keep=["doc_id"], with_groups=False)
