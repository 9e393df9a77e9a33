"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text longer than ``chunk`` characters is cut into chunks that overlap by
``overlap``. Tasks pre-tokenise the chunks in parallel. A chunk starts at an
arbitrary place, but where one of its pre-token boundaries is also a boundary
of the chunk before it, both go on alike: there the text can be cut for good.
The pieces between cuts are encoded in parallel and put together in order. If
an overlap holds no common boundary (one word fills it), the texts around it
stay one piece, up to the end of the document if need be: slower, never wrong.
Shorter texts are one piece from the start and are encoded where they lie,
without a shuffle.

A null text is encoded as an empty one: no ids. Repeated rows and null ids are
rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, emit, table
from markwise.llm.byte_pairs import BytePairs, load
from markwise.session import written

CHUNK, OVERLAP = 1 << 16, 1 << 10

Finish = Callable[[list[int], BytePairs], tuple]


def cuts_in(text: str, pairs: BytePairs, at_end: bool) -> list[int]:
    """Pre-token boundaries of a chunk at which it may be cut.

    The pre-token that touches the end of the chunk could go on behind it, so
    its end is no boundary unless the text ends there; and behind white space
    no cut is made, as what follows decides where white space is split.
    """
    found = []
    for match in pairs.pieces.finditer(text):
        end = match.end()
        if end < len(text) or at_end:
            if not text[end - 1].isspace():
                found.append(end)
    return found


def meeting_points(chunks: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Cuts of a text from (chunk number, head cuts, tail cuts) of its chunks.

    A chunk whose own beginning did not meet the chunk before it proves
    nothing about those behind it, so cutting ends at the first miss.
    """
    ordered = sorted(chunks)
    cuts = []
    for (_, _, tail), (_, head, _) in zip(ordered, ordered[1:], strict=False):
        common = sorted(set(tail) & set(head))
        if not common:
            break
        cuts.append(common[0])
    return cuts


def _split(rows: DataFrame, schema: str, ends: Callable[[int, list[int]], Iterator[tuple[int, int, int]]]) -> DataFrame:
    """(row, part, start, text) for the parts of the texts of (row, text, cuts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["row", "part", "start", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out, size = [], 0
            for row, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part, start, end in ends(len(text), cuts or []):
                    out.append((row, part, start, text[start:end]))
                    size += end - start
                    if size >= 1 << 22:
                        yield emit(names, types, out)
                        out, size = [], 0
            yield emit(names, types, out)

    return rows.mapInArrow(run, schema)


def encode_long(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, ids) for a written table (row, text) of long texts."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "row long, part long, start long, text string"

    def chunks(n: int, _: list[int]) -> Iterator[tuple[int, int, int]]:
        for part, start in enumerate(range(0, n, chunk)):
            yield part, start, min(n, start + chunk + overlap)

    def pieces(n: int, cuts: list[int]) -> Iterator[tuple[int, int, int]]:
        for part, (start, end) in enumerate(zip([0, *cuts], [*cuts, n], strict=True)):
            yield part, start, end

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        lists = pa.list_(pa.int64())
        for batch in batches:
            out = []
            for row, part, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [start + end for end in cuts_in(text, pairs, at_end=len(text) <= chunk)]
                head = [end for end in found if end <= start + overlap]
                tail = [end for end in found if end > start + chunk]
                out.append((row, part, head, tail))
            yield emit(["row", "part", "head", "tail"], [pa.int64(), pa.int64(), lists, lists], out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        for batch in batches:
            out = [
                (row, part, pairs.encode(text))
                for row, part, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            yield emit(["row", "part", "ids"], [pa.int64(), pa.int64(), pa.list_(pa.int32())], out)

    no_cuts = F.lit(None).cast("array<bigint>").alias("cuts")
    spread = _split(rows.select("row", "text", no_cuts), schema, chunks).repartition(width, "row", "part")
    bounds = spread.mapInArrow(boundaries, "row long, part long, head array<long>, tail array<long>")
    met = bounds.groupBy("row").agg(F.collect_list(F.struct("part", "head", "tail")).alias("chunks"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (row, meeting_points([(c["part"], c["head"], c["tail"]) for c in chunks]))
                for row, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            yield emit(["row", "cuts"], [pa.int64(), pa.list_(pa.int64())], out)

    cuts = met.mapInArrow(stitch, "row long, cuts array<long>")
    parts = _split(rows.join(cuts, "row").select("row", "text", "cuts"), schema, pieces)
    encoded = parts.repartition(width, "row", "part").mapInArrow(encode, "row long, part long, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return encoded.groupBy("row").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def encode_documents(
    df: DataFrame,
    path: str,
    outputs: T.StructType,
    finish: Finish,
    text: str = "text",
    keep: list[str] | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``df[keep]`` with the columns ``finish`` makes of each text's ids."""
    keep = [name for name in (df.columns if keep is None else keep) if name not in {f.name for f in outputs}]
    own = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(df[text], F.lit("")).alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    short = own.filter(F.length("text") <= chunk)
    # written, so that the numbers of the rows stay what they are
    long = written(own.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long")

    def encoding():
        pairs = load(path)

        def work(texts):
            return columns_of([finish(pairs.encode(t), pairs) for t in texts.to_pylist()], len(outputs))

        return work

    def finishing():
        pairs = load(path)

        def work(ids):
            return columns_of([finish(i, pairs) for i in ids.to_pylist()], len(outputs))

        return work

    done = add_columns(short, ["text"], outputs, encoding, names)
    joined = long.drop("text").join(encode_long(long.select("row", "text"), path, chunk, overlap), "row")
    rest = add_columns(joined, ["ids"], outputs, finishing, names)
    both = done.unionByName(rest)
    return both.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[f.name for f in outputs])


def columns_of(rows: list[tuple], width: int) -> list:
    return list(zip(*rows, strict=True)) if rows else [[] for _ in range(width)]


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def token_ids(df: DataFrame, path: str, **options) -> DataFrame:
    """``df[keep]`` with the ids of each text."""
    return encode_documents(df, path, IDS, lambda ids, _: (ids,), **options)


def decode_documents(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df[keep]`` with ``decoded``, the raw bytes of the ids (null: none)."""

    def make():
        pairs = load(path)
        return lambda column: [[pairs.decode(i or []) for i in column.to_pylist()]]

    return add_columns(df, [ids], T.StructType([T.StructField("decoded", T.BinaryType())]), make, keep)


DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def digests(ids: list[int], pairs: BytePairs) -> tuple[int, str, str]:
    listed = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(pairs.decode(ids)).hexdigest()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(
        table(spark, sf_dir, "documents"),
        vocabulary_path("byte_bpe_multi_50k.tiktoken"),
        DIGESTS,
        digests,
        keep=["doc_id"],
    )
