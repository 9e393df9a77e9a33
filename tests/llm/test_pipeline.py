"""The pipeline's stages on the given tables and on planted documents."""

import corpus_pipeline as pipeline
from markwise.llm.batches import table
from markwise.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_after(spark, docs, folder):
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    return kept, docs


def test_stages_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    documents = table(spark, folder, "documents")
    every = {r.doc_id for r in documents.select("doc_id").collect()}
    kept, docs = kept_after(spark, documents, folder)
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    assert len(every - kept["language_id"]) <= 5
    dropped = kept["language_id"] - kept["quality_rules"]
    assert sum(labels.get(i) == 1 for i in dropped) <= 2
    assert sum(labels.get(i) == 0 for i in kept["quality_rules"]) <= 3
    pieces = pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == kept["near_dedup"]
    for doc_id in kept["near_dedup"]:
        own = [p for p in pieces if p.doc_id == doc_id]
        assert sum(p.length for p in own) == own[0].doc_tokens
    assert docs.count() == len(kept["near_dedup"])


def test_planted_copies_and_junk(spark, small_dir, documents_of):
    clean = [r for r in table(spark, small_dir, "documents").filter("n_chars > 1200 AND doc_id < 150").orderBy("doc_id").collect()]
    words = clean[0].text.split()
    near = " ".join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 + 1 :])
    rows = [(r.doc_id, r.text, r.lang) for r in clean]
    rows += [(9001, clean[1].text, "en"), (9002, near, "en"), (9003, "$$$ *** " * 200, "en"), (9004, None, None), (9005, "12 34", "en")]
    docs = documents_of(rows).selectExpr(*COLUMNS)
    kept, _ = kept_after(spark, docs, small_dir)
    assert {9004, 9005, 9003}.isdisjoint(kept["language_id"])
    assert 9001 in kept["quality_rules"] and 9001 not in kept["near_dedup"] and 9002 not in kept["near_dedup"]


def test_empty_table(spark, small_dir, documents_of):
    docs = documents_of([(1, "a")]).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, small_dir).count() == 0
