"""Packing: every id once, sequences gapless, no padding, as the library encodes."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from markwise.llm.batches import table
from markwise.llm.packing import fills, least_squares, op4_packing, pack, plan_windows, repeats

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, texts, window):
    """``texts`` by id; ``pieces`` with their ids."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for doc_id, text in texts.items():
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[doc_id], key=lambda p: p.start)
        got = [i for p in own for i in np.frombuffer(bytes(p.ids), "<u4").tolist()]
        assert got == want
        assert all(p.doc_tokens == len(want) for p in own)
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0  # full, or another power of two
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("window", [32, 2048])
def test_every_id_lies_in_one_piece(spark, documents_of, window):
    texts = {i: ("word " * (i * 37 % 90)) + "é\n" * (i % 5) for i in range(150)}
    texts |= {150: None, 151: "", 152: "same text", 153: "same text", 154: "long text " * 3000}
    df = documents_of(list(texts.items())).repartition(3)
    check(pack(df, PATH, keep=["doc_id"], window=window).collect(), texts, window)


def test_equal_texts_of_any_number(spark, documents_of):
    texts = {i: "a hot text of some words" for i in range(700)}
    check(pack(documents_of(list(texts.items())), PATH, keep=["doc_id"], window=64).collect(), texts, 64)


def test_least_squares_finds_an_exact_mixture():
    counts = np.zeros(64, np.int64)
    for lengths, n in (((40, 24), 300), ((30, 20, 14), 200), ((32, 32), 100)):
        for v in lengths:
            counts[v] += n
    columns = fills(counts, 64)
    chosen = repeats(columns, least_squares(columns, counts, 2000), counts)
    assert sum(n for _, n in chosen) == 600
    plan = plan_windows(counts, 64)
    assert plan.stream_tokens == 0 and plan.sequences == 600


def test_whole_table(spark, small_dir):
    texts = {r.doc_id: r.text for r in table(spark, small_dir, "documents").select("doc_id", "text").collect()}
    check(pack(table(spark, small_dir, "documents"), PATH, keep=["doc_id"]).collect(), texts, 2048)
    assert op4_packing(spark, small_dir).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]


def test_empty_table_extra_columns_and_null_ids(spark, documents_of):
    df = documents_of([(None, "a"), (None, "a"), (1, None)]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "start")
    got = pack(df, PATH).collect()
    assert len(got) == 3 and sum(p.length for p in got) == 5
    assert pack(df.limit(0), PATH).count() == 0
