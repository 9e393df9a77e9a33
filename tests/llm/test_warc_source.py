"""WARC archives: round trips, other tools' members, ranges, predicates."""

import gzip
import hashlib
import os
import zlib
from collections import Counter

from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm import warc_source
from markwise.llm.warc_source import base32_sha1, member, op8_warc, page_records, read_warc, write_warc

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)


def archive(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    path = f"file://{tmp_path}/a"
    write_warc(page_records(df, **options), path)
    return path


def test_members_are_gzip_members():
    assert gzip.decompress(member(b"abc" * 1000) + member(b"d")) == b"abc" * 1000 + b"d"


def test_equal_payloads_respond_once(spark, tmp_path):
    rows = [(5, "u", "é" * 300), (3, "u", "é" * 300), (9, None, "é" * 300), (4, "u", "x"), (6, "u", "x"), (7, "u", None), (2, "u", "")]
    got = read_warc(spark, archive(spark, tmp_path, rows, least_bytes=2)).collect()
    seen = {r.record_id: r for r in got}
    assert seen["<urn:page:3>"].record_type == "response" and bytes(seen["<urn:page:3>"].payload) == ("é" * 300).encode()
    for i in (5, 9):
        r = seen[f"<urn:page:{i}>"]
        assert (r.record_type, r.refers_to, r.payload, r.payload_length) == ("revisit", "<urn:page:3>", None, 600)
        assert r.payload_digest == "sha1:" + base32_sha1(("é" * 300).encode())
    assert all(seen[f"<urn:page:{i}>"].record_type == "response" for i in (2, 4, 6, 7))
    assert seen["<urn:page:9>"].target_uri is None


def test_small_ranges_read_every_record_once(spark, tmp_path):
    rows = [(i, f"http://h/{i}", os.urandom(i % 50 * 20).hex()) for i in range(200)]
    path = archive(spark, tmp_path, rows)
    for split in ("997", "4096", "0"):
        got = Counter(r.record_id for r in read_warc(spark, path, split_bytes=split).select("record_id").collect())
        assert got == Counter(f"<urn:page:{i}>" for i in range(200)), split


def test_predicates_reach_the_source_and_keep_their_meaning(spark, tmp_path):
    rows = [(i, None if i % 3 == 0 else f"http://h{i % 2}/{i}", "same" if i % 4 == 0 else f"p{i}") for i in range(40)]
    path = archive(spark, tmp_path, rows)
    full = spark.createDataFrame(read_warc(spark, path).collect(), read_warc(spark, path).schema)
    for wanted in (
        F.col("record_type") == "revisit",
        F.col("record_type").isin("response", "x") & F.col("target_uri").startswith("http://h1/"),
        F.col("target_uri").isNull(),
        (F.col("content_length") >= 60) & (F.col("record_id") != "<urn:page:1>"),
        F.col("payload") == b"same",
    ):
        want = sorted(r.record_id for r in full.filter(wanted).collect())
        assert sorted(r.record_id for r in read_warc(spark, path).filter(wanted).collect()) == want and want
    plan = read_warc(spark, path, payload=False).filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in read_warc(spark, path, payload=False).columns
    assert "Filter (" not in plan  # the source has taken the predicate


def test_clashing_columns_and_a_long_payload(spark, tmp_path):
    rows = [(i, f"u{i}", "é" * (3_000_000 if i == 1 else i)) for i in (1, 2, 3, 3)]
    extra = {c: F.lit("z") for c in ("sha1", "first", "n", "payload", "record_type", "payload_length", "target_uri")}
    path = f"file://{tmp_path}/l"
    write_warc(page_records(spark.createDataFrame(rows, PAGES).withColumns(extra)), path)
    got = sorted((r.record_id, r.record_type, r.target_uri, r.payload_length) for r in read_warc(spark, path).collect())
    assert got == sorted((f"<urn:page:{i}>", "response", u, len(t.encode())) for i, u, t in rows)


def test_members_of_other_tools(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    os.makedirs(f"{tmp_path}/b")
    with open(f"{tmp_path}/b/x.warc.gz", "wb") as file:
        file.write(gzip.compress(record) + gzip.compress(record.replace(b"urn:x", b"urn:y")))
    got = read_warc(spark, f"file://{tmp_path}/b", split_bytes="0").collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("<urn:x>", b"body"), ("<urn:y>", b"body")]
    assert zlib.crc32(bytes(got[0].payload)) == zlib.crc32(b"body")


def test_ranges_lose_no_members_of_other_tools(spark, tmp_path, monkeypatch):
    os.makedirs(f"{tmp_path}/d")
    bodies = {f"<urn:{i}>": os.urandom(i % 40 * 50).hex().encode() for i in range(300)}
    records = [
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
        for i, b in bodies.items()
    ]
    with open(f"{tmp_path}/d/plain.warc.gz", "wb") as file:
        file.write(b"".join(map(gzip.compress, records[:150])))
    with open(f"{tmp_path}/d/mixed.warc.gz", "wb") as file:
        file.write(b"".join((member, gzip.compress)[n % 3 > 0](r) for n, r in enumerate(records[150:])))
    for split in ("997", "20000", "0"):
        got = read_warc(spark, f"file://{tmp_path}/d", split_bytes=split).select("record_id", "payload").collect()
        assert len(got) == 300 and {r.record_id: bytes(r.payload) for r in got} == bodies, split
        assert read_warc(spark, f"file://{tmp_path}/d", payload=False, split_bytes=split).count() == 300
    # members longer than a window
    monkeypatch.setattr(warc_source, "WINDOW_BYTES", 100)
    reader = warc_source.WarcReader({"path": f"file://{tmp_path}/d"}, warc_source.schema_of(True))
    with fs.LocalFileSystem().open_input_file(f"{tmp_path}/d/plain.warc.gz") as file:
        size = file.size()
        rows = list(reader.records(file, warc_source.FileRange("", 0, size)))
    assert {r["record_id"]: r["payload"] for r in rows} == dict(list(bodies.items())[:150])


RECORD = "WARC/1.0\r\nWARC-Type: {type}\r\nWARC-Record-ID: <urn:{id}>\r\nContent-Length: {length}\r\n\r\n"


def plain_record(id, body, type="resource"):
    return RECORD.format(type=type, id=id, length=len(body)).encode() + body + b"\r\n\r\n"


def read_files(spark, folder, files, **options):
    """Rows of an archive folder that holds the files, by record id."""
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as file:
            file.write(data)
    rows = read_warc(spark, f"file://{folder}", **options).collect()
    assert len({r.record_id for r in rows}) == len(rows)
    return {r.record_id: r for r in rows}


def test_members_with_several_records(spark, tmp_path):
    bodies = {f"<urn:{i}>": os.urandom(i * 40).hex().encode() + b"\r\n\r\nWARC/1.0\r\n" for i in range(90)}
    records = [plain_record(i[5:-1], b, "resource" if n % 2 else "metadata") for n, (i, b) in enumerate(bodies.items())]
    joined = [b"".join(records[at : at + 3]) for at in range(0, 90, 3)]
    files = {"a.warc.gz": b"".join(map(gzip.compress, joined[:15])), "b.warc.gz": b"".join(map(member, joined[15:]))}
    for split in ("500", "0"):
        got = read_files(spark, f"{tmp_path}/f", files, split_bytes=split)
        assert {i: bytes(r.payload) for i, r in got.items()} == bodies, split
        assert read_warc(spark, f"file://{tmp_path}/f", payload=False, split_bytes=split).count() == 90
        odd = read_warc(spark, f"file://{tmp_path}/f", split_bytes=split).filter("record_type = 'resource'").collect()
        assert {r.record_id: bytes(r.payload) for r in odd} == dict(list(bodies.items())[1::2])


def test_plain_files_line_ends_and_folded_headers(spark, tmp_path):
    bodies = {f"<urn:{i}>": b"x" * (i * 3000) + b"\n\n" * (i % 3) for i in range(60)}
    records = [plain_record(i[5:-1], b) for i, b in bodies.items()]
    unix = [r.replace(b"\r\n", b"\n").replace(b"Content-Length", b"WARC-Target-URI: http://h/\n  a\nContent-Length") for r in records]
    files = {"a.warc": b"".join(records[:30]), "b.warc.gz": b"".join(map(gzip.compress, unix[30:45])), "c.warc": b"".join(unix[45:])}
    for split in ("10000", "0"):
        got = read_files(spark, f"{tmp_path}/g", files, split_bytes=split)
        assert {i: bytes(r.payload) for i, r in got.items()} == bodies, split
        assert got["<urn:31>"].target_uri == "http://h/ a" and got["<urn:1>"].target_uri is None
        assert read_warc(spark, f"file://{tmp_path}/g", payload=False, split_bytes=split).count() == 60


def test_http_blocks_end_with_their_record(spark, tmp_path):
    typed = lambda r: r.replace(b"Content-Length", b"Content-Type: application/http\r\nContent-Length", 1)
    open_block, block = b"HTTP/1.1 304 Not Modified\r\nServer: s", b"HTTP/1.1 200 OK\nContent-Length: 3\n\nabc"
    data = typed(plain_record("1", open_block)) + typed(plain_record("2", block)) + plain_record("3", b"")
    got = read_files(spark, f"{tmp_path}/h", {"a.warc.gz": gzip.compress(data)})
    assert [bytes(got[f"<urn:{i}>"].payload) for i in (1, 2, 3)] == [open_block, b"abc", b""]
    assert got["<urn:2>"].payload_length == 3


def test_digests_in_both_spellings(spark, tmp_path):
    sha1 = hashlib.sha1(b"body").hexdigest()
    kinds = ["sha1:" + sha1, "SHA1:" + sha1.upper(), "sha1:" + base32_sha1(b"body").lower(), "sha256:" + hashlib.sha256(b"body").hexdigest(), "x:y"]
    records = [plain_record(n, b"body").replace(b"Content-L", f"WARC-Payload-Digest: {d}\r\nContent-L".encode()) for n, d in enumerate(kinds)]
    got = read_files(spark, f"{tmp_path}/i", {"a.warc": b"".join(records)})
    assert sorted(r.payload_digest for r in got.values()) == sorted(kinds)
    assert not warc_source.digest_holds("sha1:" + sha1, b"other") and not warc_source.digest_holds("md5:00", b"body")


def test_one_file_and_subfolders(spark, tmp_path):
    files = {"a.warc.gz": gzip.compress(plain_record("1", b"a")), "2024/05/b.warc": plain_record("2", b"b"), "_tasks-x/c.warc": b"half", "2024/notes.txt": b"-", "empty.warc": b""}
    assert set(read_files(spark, f"{tmp_path}/j", files)) == {"<urn:1>", "<urn:2>"}
    assert [r.record_id for r in read_warc(spark, f"file://{tmp_path}/j/2024/05/b.warc").collect()] == ["<urn:2>"]


def test_archives_inside_payloads_begin_no_range(spark, tmp_path):
    inner = b"".join(member(plain_record(f"inner{i}", os.urandom(40)), mark=b"another!") for i in range(9))
    rows = [("resource", f"<urn:{i}>", inner if i % 2 else os.urandom(300)) for i in range(6)]
    path = f"file://{tmp_path}/k"
    write_warc(spark.createDataFrame(rows, "record_type string, record_id string, payload binary").coalesce(1), path)
    for split in ("150", "700", "0"):
        got = read_warc(spark, path, split_bytes=split).collect()
        assert sorted((r.record_id, bytes(r.payload)) for r in got) == sorted((i, bytes(p)) for _, i, p in rows), split


def test_what_is_no_record_is_an_error(tmp_path):
    reader = warc_source.WarcReader({"path": f"file://{tmp_path}"}, warc_source.schema_of(True))
    whole = gzip.compress(plain_record("1", b"a" * 5000))
    for n, data in enumerate((b"no archive", whole + b"junk", whole[:-30], gzip.compress(plain_record("1", b"a") + b"more"))):
        with open(f"{tmp_path}/{n}.warc.gz", "wb") as file:
            file.write(data)
        with fs.LocalFileSystem().open_input_file(f"{tmp_path}/{n}.warc.gz") as file:
            try:
                list(reader.records(file, warc_source.FileRange("", 0, len(data))))
                raise AssertionError(n)
            except ValueError:
                pass


def test_damaged_payload_is_reported(spark, tmp_path):
    bad = spark.createDataFrame([("response", "<urn:1>", "sha1:" + base32_sha1(b"other"), b"x")], "record_type string, record_id string, payload_digest string, payload binary")
    write_warc(bad, f"file://{tmp_path}/c")
    assert read_warc(spark, f"file://{tmp_path}/c", verify="false").count() == 1
    try:
        read_warc(spark, f"file://{tmp_path}/c").select("payload").collect()
        raise AssertionError("not reported")
    except Exception as problem:
        assert "does not match its digest" in str(problem)


def test_query_null_ids_and_empty_table(spark, small_dir, tmp_path, table_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    extra = spark.createDataFrame([(None, None, "z"), (None, None, "z"), (10**9, "u", "z"), (10**9, "u", "z")], PAGES)
    got = op8_warc(spark, table_dir(pages=pages.unionByName(extra))).collect()
    assert len(got) == pages.count() + 4
    assert sorted((str(r.page_id), r.record_type) for r in got if r.payload_bytes == 1) == [
        (str(10**9), "response"), (str(10**9), "response"), ("None", "revisit"), ("None", "revisit"),
    ]
    digests = {r.page_id: r.payload_digest for r in got}
    for r in pages.limit(5).collect():
        assert digests[r.page_id] == base32_sha1(r.html.encode()) and len(hashlib.sha1().digest()) == 20
    write_warc(page_records(extra.limit(0)), f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0
