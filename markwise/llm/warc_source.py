"""WARC archives as a Python data source, and pages written and read through it.

Written archives hold one gzip member per record. A member's header tells its
compressed and its full length (extra field "sl"), so a reader goes from record
to record without inflating what lies between. It inflates a record's headers
first; if they fail a pushed-down predicate, or payloads are not asked for, the
rest of the record stays as it is.

Files are planned as ranges of ``split_bytes``. Every member of a written file
carries the file's own random mark (extra field "mk"). A range owns what lies
from the first marked member that begins in it to the next range's first one,
so bytes that only look like a member (an archive inside a payload) begin no
range. Files without marks belong to their first range as a whole.

Archives of other tools: members without lengths are inflated, in windows, to
find their ends; a member may hold any number of records, a file may be plain,
lines may end in ``\n`` alone. What is not a record is an error, never skipped.
A path may be one file or a folder, read with its subfolders, but for names that
begin with "_" or ".". SHA-1, SHA-256, SHA-512 and MD5 digests are verified in
base32 or hexadecimal; others are passed on as they are.

A payload lies in memory once as a whole where it is asked for, and in windows
of some MB where it is not. Extra columns of pages are left out of the archives.

Tasks write to files of their own below ``_tasks``; the driver moves them in
place when all have succeeded, so lost tasks and repeated ones leave nothing.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import table
from markwise.session import fresh_path, written

SPLIT_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
BROADCAST_BYTES = 16 << 20
GZIP = b"\x1f\x8b\x08"
MEMBER = GZIP + b"\x04"
MARK = b"mk" + struct.pack("<H", 8)
MARK_AT = 24
HEAD_BYTES = 64
WINDOW_BYTES = 4 << 20
MOVES_AT_ONCE = 32
BLANK_LINE = re.compile(rb"\r?\n\r?\n")
DIGESTS = ("md5", "sha1", "sha256", "sha512")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Columns read from headers alone, with the header each comes from.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}


def schema_of(with_payload: bool) -> T.StructType:
    fields = [T.StructField(name, T.StringType()) for name in HEADERS]
    fields += [T.StructField("content_length", T.LongType()), T.StructField("payload_length", T.LongType())]
    return T.StructType(fields + [T.StructField("payload", T.BinaryType())] * with_payload)


def member(content: bytes, level: int = 1, mark: bytes = b"") -> bytes:
    """A gzip member whose header holds its compressed and its full length, and its file's mark of 8 bytes."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(content) + deflate.flush()
    marked = MARK + mark if mark else b""
    total = 10 + 2 + 12 + len(marked) + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(content) & 0xFFFFFFFF) + marked
    head = MEMBER + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """One record of a row of the source's columns (nulls: header left out)."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1"]
    for column, name in (
        ("record_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("date", "WARC-Date"),
        ("target_uri", "WARC-Target-URI"), ("payload_digest", "WARC-Payload-Digest"), ("refers_to", "WARC-Refers-To"),
    ):
        if row[column] is not None:
            lines.append(f"{name}: {' '.join(row[column].split())}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def headers_of(lines: bytes) -> dict[str, str]:
    """Headers by lower-cased name; a line that begins with white space continues the one before."""
    text = re.sub(r"\r?\n[ \t]+", " ", lines.decode("utf-8", "replace"))
    pairs = (line.partition(":") for line in re.split(r"\r?\n", text)[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


class Inflating:
    """A gzip member, inflated as far as asked for.

    ``refill`` gives the data that follow what has been given (empty: none).
    """

    def __init__(self, data: memoryview, refill: Callable[[int], bytes] = lambda passed: b""):
        self.inflate = zlib.decompressobj(31)
        self.data, self.at, self.passed, self.refill = data, 0, 0, refill

    def pull(self, step: int) -> bytes:
        """Some more of the content; empty at its end."""
        while not self.inflate.eof:
            if self.at >= len(self.data):
                data = self.refill(self.passed + len(self.data))
                if not data:
                    raise ValueError("a member is cut short")
                self.passed += len(self.data)
                self.data, self.at = memoryview(data), 0
            content = self.inflate.decompress(self.data[self.at : self.at + step])
            self.at += step
            if content:
                return content
        return b""

    def end(self) -> int:
        """Where the next member begins, counted from this one."""
        while self.pull(1 << 16):
            pass
        return self.passed + min(self.at, len(self.data)) - len(self.inflate.unused_data)


class Content:
    """Records behind each other, taken from ``pull`` as far as asked for.

    Positions count from the first byte. ``jump`` goes to a position without reading up to it.
    """

    def __init__(self, pull: Callable[[int], bytes], jump: Callable[[int], object] | None = None):
        self.pull, self.jump = pull, jump
        self.base, self.held = 0, bytearray()

    def more(self, step: int = 2048) -> bool:
        data = self.pull(step)
        self.held += data
        return bool(data)

    def reach(self) -> int:
        return self.base + len(self.held)

    def part(self, start: int, stop: int) -> bytes:
        """The bytes from start to stop, fewer at the end."""
        while self.reach() < stop and self.more(2048 if stop - self.reach() < 1 << 14 else 1 << 16):
            pass
        return bytes(self.held[start - self.base : stop - self.base])

    def blank_line(self, start: int, stop: int | None = None) -> tuple[int, int] | None:
        """Where the first empty line behind start begins (with the end of the line before) and ends."""
        seen = start
        while True:
            limit = self.reach() if stop is None else min(stop, self.reach())
            found = BLANK_LINE.search(self.held, seen - self.base, limit - self.base)
            if found:
                return self.base + found.start(), self.base + found.end()
            seen = max(start, limit - 3)
            if limit == stop or not self.more():
                return None

    def drop(self, to: int) -> None:
        """Lets go of what lies before a position."""
        while self.reach() < to:
            if self.jump:
                self.jump(to)
                self.base = to
                self.held.clear()
                return
            self.base = self.reach()
            self.held.clear()
            if not self.more(1 << 16):
                return
        del self.held[: to - self.base]
        self.base = to

    def next_record(self, at: int) -> int | None:
        """Where the record behind the empty lines at a position begins; None at the end."""
        while byte := self.part(at, at + 1):
            if byte not in b"\r\n":
                return at
            at += 1
        return None


def member_lengths(head: memoryview) -> tuple[int, int] | None:
    """The compressed and the full length in a member's header."""
    if bytes(head[:4]) == MEMBER and bytes(head[12:14]) == b"sl":
        return struct.unpack("<II", head[16:24])
    return None


def mark_of(head: memoryview) -> bytes | None:
    marked = bytes(head[MARK_AT : MARK_AT + 12])
    return marked if member_lengths(head) and len(marked) == 12 and marked.startswith(MARK) else None


def digest_holds(digest: str | None, payload: bytes) -> bool:
    """Whether a labelled digest is the payload's; true where the algorithm is not known."""
    algorithm, _, value = (digest or "").partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in DIGESTS:
        return True
    made = hashlib.new(algorithm, payload).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def archives_in(system: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    """The archives of a folder and its subfolders by path, or the file itself."""
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    top = len(info.path.rstrip("/")) + 1
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    hidden = lambda path: any(name[:1] in ("_", ".") for name in path[top:].split("/"))
    found = [f for f in found if f.type == fs.FileType.File and ".warc" in f.base_name and not hidden(f.path)]
    return sorted(found, key=lambda f: f.path)


@dataclass(frozen=True)
class Predicate:
    """A test of one header column."""

    column: str
    kind: str
    values: tuple

    def holds(self, row: dict) -> bool:
        value = row[self.column]
        if self.kind == "null":
            return value is None
        if self.kind == "not null":
            return value is not None
        if value is None:
            return False
        if self.kind == "in":
            return value in self.values
        if self.kind == "starts":
            return value.startswith(self.values[0])
        low, high = self.values
        return (low is None or value >= low) and (high is None or value <= high)


def predicate_of(wanted: ds.Filter) -> Predicate | None:
    """The predicate of a filter of Spark's; None if the source leaves it to Spark."""
    column = wanted.attribute[0] if len(getattr(wanted, "attribute", ())) == 1 else None
    if column not in HEADERS and column not in ("content_length",):
        return None
    match wanted:
        case ds.EqualTo() | ds.EqualNullSafe():
            return Predicate(column, "in", (wanted.value,)) if wanted.value is not None else None
        case ds.In():
            return Predicate(column, "in", tuple(wanted.value))
        case ds.IsNull():
            return Predicate(column, "null", ())
        case ds.IsNotNull():
            return Predicate(column, "not null", ())
        case ds.StringStartsWith():
            return Predicate(column, "starts", (wanted.value,))
        case ds.GreaterThanOrEqual():
            return Predicate(column, "range", (wanted.value, None))
        case ds.LessThanOrEqual():
            return Predicate(column, "range", (None, wanted.value))
    return None


@dataclass
class FileRange(ds.InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Moved(ds.WriterCommitMessage):
    path: str | None


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.root = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.verify = options.get("verify", "true").lower() == "true"
        self.with_payload = "payload" in schema.names
        self.schema = schema
        self.predicates: list[Predicate] = []

    def pushFilters(self, filters):
        for wanted in filters:
            predicate = predicate_of(wanted)
            if predicate is None:
                yield wanted
            else:
                self.predicates.append(predicate)

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.root)
        ranges = []
        for file in archives_in(system, root):
            step = self.split or file.size or 1
            ranges += [FileRange(file.path, at, min(at + step, file.size)) for at in range(0, file.size, step)]
        return ranges or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_file(partition.path) as file:
            rows, size = [], 0
            for row in self.records(file, partition):
                rows.append(row)
                size += len(row.get("payload") or b"") + 500
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    def records(self, file, partition: FileRange) -> Iterator[dict]:
        """Records of the range: up to the first marked member that begins behind it, or the file's end."""
        window, base = b"", partition.start
        total = file.size()

        def load(at: int, least: int) -> memoryview:
            nonlocal window, base
            if at < base or at + least > base + len(window):
                file.seek(at)
                window, base = file.read(max(least, WINDOW_BYTES)), at
            return memoryview(window)[at - base :]

        def following(passed: int) -> bytes:
            file.seek(at + passed)
            return file.read(WINDOW_BYTES)

        file.seek(0)
        first = file.read(HEAD_BYTES)
        mark, at = mark_of(memoryview(first)), 0
        if partition.start:
            at = self.first_marked(file, partition, mark) if mark else total
        elif not first.startswith(GZIP):
            file.seek(0)
            yield from self.rows_of(Content(lambda step: file.read(max(step, 1 << 16)), file.seek))
            return
        while at < total:
            head = load(at, min(HEAD_BYTES, total - at))
            if mark and at >= partition.stop and mark_of(head) == mark:
                return
            lengths = member_lengths(head)
            if lengths:
                data = load(at, min(lengths[0], total - at))[: lengths[0]]
                yield from self.rows_of(Content(Inflating(data).pull), lengths[1])
                at += lengths[0]
            elif bytes(head[:3]) == GZIP:
                inflating = Inflating(head, following)
                yield from self.rows_of(Content(inflating.pull))
                at += inflating.end()
            else:
                raise ValueError(f"no gzip member at byte {at} of {partition.path}")

    def first_marked(self, file, partition: FileRange, mark: bytes) -> int:
        """The first marked member that begins in the range; the file's end if there is none."""
        at = partition.start
        while at < partition.stop:
            file.seek(at)
            data = memoryview(file.read(min(WINDOW_BYTES, partition.stop - at) + HEAD_BYTES))
            for found in re.finditer(re.escape(mark), data):
                place = found.start() - MARK_AT
                if place >= 0 and mark_of(data[place:]) == mark:
                    return at + place if at + place < partition.stop else file.size()
            at += max(1, len(data) - HEAD_BYTES)
        return file.size()

    def rows_of(self, content: Content, full: int | None = None) -> Iterator[dict]:
        """The rows of records behind each other; ``full`` is the content's length where it is known."""
        at = content.next_record(0)
        while at is not None:
            if content.part(at, at + 5) != b"WARC/" or not (ends := content.blank_line(at)):
                raise ValueError("what follows a record is none")
            row, stop = self.row_of(content, at, *ends)
            if row is not None:
                yield row
            if stop is None or (full is not None and stop + 4 >= full):
                return
            content.drop(stop)
            at = content.next_record(stop)

    def row_of(self, content: Content, at: int, head_end: int, start: int) -> tuple[dict | None, int | None]:
        """The row of a record, None where a predicate fails, and where its block ends (None: not told)."""
        head = headers_of(content.part(at, head_end))
        row: dict = {column: head.get(name) for column, name in HEADERS.items()}
        row["content_length"] = int(head["content-length"]) if head.get("content-length", "").isdigit() else None
        stop = None if row["content_length"] is None else start + row["content_length"]
        if not all(predicate.holds(row) for predicate in self.predicates):
            return None, stop
        http = content.blank_line(start, stop) if "http" in (row["content_type"] or "") else None
        fields = headers_of(content.part(start, http[0])) if http else {}
        row["payload_length"] = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
        if self.with_payload and row["record_type"] != "revisit" and stop is not None:
            payload = content.part(http[1] if http else start, stop)
            row["payload"], row["payload_length"] = payload, len(payload)
            if self.verify and not digest_holds(row["payload_digest"], payload):
                raise ValueError(f"payload of {row['record_id']} does not match its digest")
        return row, stop


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.tasks = f"{self.root.rstrip('/')}/_tasks-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        system, folder = fs.FileSystem.from_uri(self.tasks)
        system.create_dir(folder)
        path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        mark, n = os.urandom(8), 0
        with system.open_output_stream(path, compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(record_bytes(row), mark=mark))
                    n += 1
        if not n:
            system.delete_file(path)
        return Moved(path if n else None)

    def commit(self, messages: list[Moved | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.root)
        system.create_dir(root)
        if self.overwrite:
            for old in archives_in(system, root):
                system.delete_file(old.path)
        paths = [message.path for message in messages if message and message.path]
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            list(pool.map(lambda path: system.move(path, f"{root}/{path.rpartition('/')[2]}"), paths))
        self.abort(messages)

    def abort(self, messages: list[Moved | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.tasks)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class WarcDataSource(ds.DataSource):
    """``spark.read.format("warc").option("payload", "false").load(folder)``"""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return schema_of(self.options.get("payload", "true").lower() == "true")

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(payload=str(payload).lower(), **options).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Writes rows of the source's columns (missing ones: null), a file per task."""
    register(records.sparkSession)
    schema = schema_of(True)
    columns = [F.col(f.name) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    records.select(*columns).write.format("warc").mode("append").save(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.pandas_udf(T.StringType())
def base32_of_hex(column):
    return column.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode())


def page_records(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records of pages: the least id of equal payloads responds, others revisit it.

    Payloads are compared by SHA-1. Only payloads that occur again are listed;
    the list is broadcast if its counted bytes are within a bound. Null html is
    an empty payload. A row without an id revisits the least id of its payload;
    among rows without ids all respond, as do repeated rows of the least id. An
    empty table gives no records. Further columns are left out, whatever their
    names; a payload of any length is one record.
    """
    payload = F.encode(F.coalesce(df[html], F.lit("")), "utf-8")
    pages = df.select(df[id].alias("page_id"), df[url].alias("target_uri"), payload.alias("payload")).select(
        "*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_length")
    )
    again = (
        pages.filter(F.col("payload_length") >= least_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("sha1", "first")
    )
    again = written(again, "again")
    if again.count() * 60 <= BROADCAST_BYTES:
        again = F.broadcast(again)
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return pages.join(again, "sha1", "left").select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        name(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.concat(F.lit("sha1:"), base32_of_hex("sha1")).alias("payload_digest"),
        F.when(revisits, name(F.col("first"))).alias("refers_to"),
        "payload_length",
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def page_of(record_id):
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.nullif(page_of(F.col(c)), F.lit("")).cast("long")
    return read_warc(spark, path).select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages
), f AS (SELECT s, min(page_id) AS first FROM p GROUP BY s)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((((strpos('0123456789abcdef', s[(5 * i) // 4 + 1]) - 1) * 16 + strpos('0123456789abcdef', s[(5 * i) // 4 + 2]) - 1)
      >> (3 - (5 * i) % 4)) & 31)::INTEGER + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (s)
"""
