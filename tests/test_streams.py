"""Streams fed batch by batch."""

import datetime as dt
import json

import pytest

from markwise.sources import versions
from markwise.plans import catalog_streaming
from markwise.streaming.composite import composite_stream
from markwise.streaming.evaluate import evaluate_stream
from markwise.streaming.ledger import ledger_stream

ANSWERS = "answer_id string, asked timestamp, regression array<struct<exp_num: string, evaluation: string, score: double>>"
RESPONSES = "answer_id string, lesson string, came timestamp, response string, n_concepts int"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def response(known):
    concepts = {f"concept_{i}": {"is_known": k, "confidence": 0.75, "justification": ""} for i, k in enumerate(known)}
    return json.dumps({"answers": {"answer_1": {"answer_text": "it", "concepts": concepts}}})


@pytest.fixture()
def feed(spark, tmp_path):
    """Appends rows to a folder that a stream reads."""

    def make(name, schema):
        path = tmp_path / name
        path.mkdir()
        return (
            spark.readStream.schema(schema).parquet(str(path)),
            lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path)),
        )

    return make


def test_grader_wins_only_in_time(spark, tmp_path, feed):
    asked, ask = feed("asked", ANSWERS)
    came, come = feed("came", RESPONSES)
    masks = spark.createDataFrame([("l", "a", "concept_0"), ("l", "b", "concept_1")], "lesson string, exp_num string, concept string")
    joined = composite_stream(asked, came, masks, late="5 seconds")
    own = [("a", "Bad", 0.6), ("b", "Bad", 0.7)]

    def run():
        stream = (
            joined.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        stream.awaitTermination()
        found = spark.read.schema(joined.schema).parquet(str(tmp_path / "out"))
        return {(r.answer_id, r.source, tuple(x.evaluation for x in r.results)) for r in found.collect()}

    ask([(name, at(i), own) for i, name in enumerate(["quick", "edge", "late", "never", "broken", "short"])])
    come([("quick", "l", at(3), response(["true", "false"]), 2)] * 2)
    first = run()
    assert {r for r in first if r[1] == "grader"} == {("quick", "grader", ("Good", "Bad"))}
    come([("edge", "l", at(11), response(["true", "true"]), 2), ("late", "l", at(12.001), response(["true", "true"]), 2)])
    come([("quick", "l", at(9), response(["true", "true"]), 2)])
    come([("broken", "l", at(5), "{", 2), ("short", "l", at(6), response(["true"]), 2), ("stranger", "l", at(6), response(["true", "true"]), 2)])
    run()
    ask([("closing", at(1000), own)])
    come([("closing", "l", at(1001), "", 2)])
    last = run()
    regressed = {(name, "regression", ("Bad", "Bad")) for name in ("late", "never", "broken", "short")}
    assert last == regressed | {("quick", "grader", ("Good", "Bad")), ("edge", "grader", ("Good", "Good"))}


def test_ledger_records_expire_and_begin_again(spark, tmp_path, feed):
    events, send = feed("events", "job_id bigint, status string, at timestamp, event_id bigint")
    day = 86_400
    updates = ledger_stream(events)
    seen = []

    def run():
        stream = (
            updates.writeStream.outputMode("update").foreachBatch(lambda batch, n: seen.extend(batch.collect()))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        stream.awaitTermination()
        rows = {(r.job_id, r.status, r.n_events, r.expired) for r in seen}
        seen.clear()
        return rows

    send([(1, "QUEUED", at(0.5), 1), (1, "IN_PROGRESS", at(0.75), 2), (2, "QUEUED", at(5 * day), 3)])
    assert run() == {(1, "IN_PROGRESS", 2, False), (2, "QUEUED", 1, False)}
    # out of order within the batch; job 1 is told of on the last second of its life
    send([(2, "SUCCESS", at(19 * day), 9), (2, "IN_PROGRESS", at(6 * day), 4), (1, "SUCCESS", at(20 * day - 0.25), 10)])
    assert run() == {(1, "SUCCESS", 3, False), (2, "SUCCESS", 3, False)}
    # the watermark passes job 1; job 2 begins again after its end, within one batch
    send([(2, "FAILURE", at(24 * day), 11), (2, "QUEUED", at(25 * day), 12), (3, "QUEUED", at(25 * day + 7200), 13)])
    assert run() == {(1, "SUCCESS", 3, True), (2, "FAILURE", 4, True), (2, "QUEUED", 1, False), (3, "QUEUED", 1, False)}
    send([(4, "QUEUED", at(60 * day), 14), (1, "QUEUED", at(60 * day), 15)])
    assert run() == {(2, "QUEUED", 1, True), (3, "QUEUED", 1, True), (4, "QUEUED", 1, False), (1, "QUEUED", 1, False)}


def test_parts_of_a_second_are_combined():
    import pandas as pd

    from markwise.streaming.ledger import combined

    rows = [(7, at(3), at(3.5), at(3.5), 2, "IN_PROGRESS", 1), (7, at(3), at(3.1), at(3.1), 1, "QUEUED", 1), (7, at(4), at(4), at(4), 3, "SUCCESS", 1)]
    names = ["job_id", "second", "first", "at", "event_id", "status", "n"]
    (got,) = combined(iter([pd.DataFrame(rows, columns=names)]))
    assert [tuple(r) for r in got.itertuples(index=False)] == [
        (7, at(3), at(3.1), at(3.5), 2, "IN_PROGRESS", 2), (7, at(4), at(4), at(4), 3, "SUCCESS", 1),
    ]


MODEL = "exp_num string, coef array<double>, intercept double"
CONFIG = "exp_num string, pos int, question string, ideal string, good array<string>, bad array<string>"


def test_stream_scores_with_the_models_of_its_batch(spark, tmp_path, feed):
    root = str(tmp_path / "store")
    vocabulary = spark.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.0, 1.0])], "word string, vector array<double>")

    def trained(lessons, intercept):
        models = [("lr2", lesson, e, [0.0] * 7, intercept) for lesson, e in lessons]
        configs = [("lr2", lesson, e, 0, "q", "red", [], []) for lesson, e in lessons if lesson != "default"]
        versions.publish({
            "models": spark.createDataFrame(models, f"arch string, lesson string, {MODEL}"),
            "configs": spark.createDataFrame(configs, f"arch string, lesson string, {CONFIG}"),
        }, root)

    def make(pin):
        models = versions.load(pin, root, "models", MODEL)
        return versions.load(pin, root, "configs", CONFIG).drop("arch"), models, vocabulary

    tables = versions.FreshTables(spark, root, make)
    answers, ask = feed("answers", "answer_id string, lesson string, exp_num string, text string")

    def run():
        evaluate_stream(answers, tables, str(tmp_path / "r"), str(tmp_path / "x"), str(tmp_path / "state"), once=True).awaitTermination()
        return {(r.answer_id, r.evaluation) for r in spark.read.parquet(str(tmp_path / "r")).collect()}

    trained([("a", "0"), ("b", "0"), ("default", "")], -1.0)
    ask([("a1", "a", None, "red"), ("b1", "b", None, "blue")])
    assert run() == {("a1", "Bad"), ("b1", "Bad")}
    trained([("a", "0")], 1.0)  # between two batches; b keeps its models
    ask([("a2", "a", None, "red"), ("b2", "b", None, "blue")])
    assert run() == {("a1", "Bad"), ("b1", "Bad"), ("a2", "Good"), ("b2", "Bad")}
    assert tables.renewed == 2
    ask([("a3", "a", None, "red")])
    assert ("a3", "Good") in run() and tables.renewed == 2


def test_a_reader_between_two_writes_sees_one_version(spark, tmp_path):
    root = str(tmp_path / "store")
    assert versions.current(spark, root).isEmpty()

    def rows(lessons, n):
        return spark.createDataFrame([("lr2", lesson, n) for lesson in lessons], "arch string, lesson string, n int")

    def seen(pin, table):
        return {(r.lesson, r.n) for r in versions.load(pin, root, table, "n int").collect()}

    versions.publish({"models": rows("ab", 1), "truths": rows("ab", 1)}, root)
    half = versions.new_version()
    versions.write_data({"models": rows("a", 2)}, root, half)
    before = versions.pinned(spark, root)
    versions.write_data({"truths": rows("a", 2)}, root, half)
    versions.write_manifest(rows("a", 2), root, half)
    after = versions.pinned(spark, root)
    for table in ("models", "truths"):
        assert seen(before, table) == {("a", 1), ("b", 1)}
        assert seen(after, table) == {("a", 2), ("b", 1)}
    versions.remove(rows("b", 0), root)
    assert seen(versions.pinned(spark, root), "truths") == {("a", 2)}


def test_a_table_in_many_files_is_streamed_like_one_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from markwise.plans import bindings

    pq.write_table(pa.table({"k": [1, 2, 3]}), tmp_path / "one.parquet")
    spark.range(9).toDF("k").repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    for name, rows in (("one", [1, 2, 3]), ("many", list(range(9)))):
        out = f"{tmp_path}/{name}-out"
        bindings.table_stream(spark, str(tmp_path), name).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.k for r in spark.read.parquet(out).collect()) == rows


def test_state_is_dealt_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(catalog_streaming, "STATE_ROWS", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "500")
        seen = []

        class Writer:
            def start(self):
                seen.append(int(spark.conf.get("spark.sql.shuffle.partitions")))

        for n in (10, 300_000, 10_000_000):
            catalog_streaming.started(Writer(), spark.range(n))
        assert seen == [spark.sparkContext.defaultParallelism, 301, 500]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "500"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
