"""Chunked encoding against the library on whole texts, and round trips."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from markwise.llm import byte_pairs
from markwise.llm.batches import table
from markwise.llm.chunked_encoding import (
    cuts_in,
    decode_documents,
    meeting_points,
    op2_byte_pair_encoding,
    token_ids,
)

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def awkward(n, length, seed):
    rng = random.Random(seed)
    letters = " \n\tab'ls1.,é\x1c\x85日 "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, length))) for _ in range(n)]


def merged(piece, ranks):
    """Brute force: join the neighbours of least rank until none can be joined."""
    parts = [bytes([b]) for b in piece]
    while True:
        options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not options:
            return [ranks[p] for p in parts]
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ids_are_those_of_merging_each_piece():
    pairs = byte_pairs.load(PATH)
    assert public_tokenizers.PATTERN == byte_pairs.PATTERN
    ranks = {token: i for i, token in enumerate(pairs.vocabulary)}
    for text in awkward(300, 60, 1):
        want = [i for piece in pairs.pieces.findall(text) for i in merged(piece.encode(), ranks)]
        assert pairs.encode(text) == want


def test_json_vocabulary_gives_the_ids_of_its_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    pairs, library = byte_pairs.load(path), Tokenizer.from_file(path)
    texts = awkward(300, 60, 2)
    assert [pairs.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [pairs.encode_array(t).tolist() for t in texts] == [pairs.encode(t) for t in texts]


def test_cuts_of_chunks_are_boundaries_of_the_text():
    pairs = byte_pairs.load(PATH)
    for text in awkward(60, 400, 3):
        true = {m.end() for m in pairs.pieces.finditer(text)}
        chunk, overlap = 50, 20
        chunks = []
        for part, start in enumerate(range(0, len(text), chunk)):
            cut = text[start : start + chunk + overlap]
            found = [start + e for e in cuts_in(cut, pairs, len(cut) <= chunk)]
            chunks.append((part, [e for e in found if e <= start + overlap], [e for e in found if e > start + chunk]))
        assert set(meeting_points(chunks)) <= true


def test_cutting_ends_at_the_first_chunk_that_does_not_meet():
    assert meeting_points([(1, [12], [25]), (0, [1], [12]), (2, [24], [33]), (3, [33], [])]) == [12]


def test_long_texts_in_small_chunks_equal_whole_texts(spark, documents_of):
    pairs = byte_pairs.load(PATH)
    texts = awkward(20, 900, 4) + ["x" * 700, "ab " * 300, " " * 500, "", "\n" * 300 + "a", None, "word", "word"]
    df = documents_of([(i if i % 7 else None, t) for i, t in enumerate(texts)])
    got = token_ids(df, PATH, keep=["text"], chunk=100, overlap=24).collect()
    assert sorted((r.text or "", r.ids) for r in got) == sorted((t or "", pairs.encode(t or "")) for t in texts)
    decoded = decode_documents(token_ids(df, PATH, keep=["text"], chunk=100, overlap=24), PATH).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in decoded)


def test_query_round_trip_on_the_given_table(spark, small_dir):
    pairs = byte_pairs.load(PATH)
    want = {}
    for doc_id, text in table(spark, small_dir, "documents").select("doc_id", "text").collect():
        ids = ",".join(map(str, pairs.encode(text)))
        want[doc_id] = (hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = op2_byte_pair_encoding(spark, small_dir).collect()
    assert {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_empty_table_and_clashing_columns(spark, documents_of):
    df = documents_of([(1, "a b")]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "row")
    assert token_ids(df, PATH).columns == ["doc_id", "text", "row", "n_chars", "ids"]
    assert token_ids(df, PATH).first().row == "s"
    assert token_ids(df.limit(0), PATH).count() == 0
