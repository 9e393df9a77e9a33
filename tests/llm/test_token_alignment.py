"""Alignments and counts against plain loops over tokens, and perfect hashes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import markwise.llm.token_alignment as module
from markwise.llm.byte_pairs import printable_bytes
from markwise.llm.perfect_hash import PerfectHash
from markwise.llm.token_alignment import OUT, op13_token_alignment, shard_starts, token_alignment

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """The contract, token by token, with the libraries' own encoders."""

    def __init__(self, texts):
        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        letters = printable_bytes()
        self.docs = []
        for text in texts:
            if not text:
                self.docs.append(([], [], []))
                continue
            found = self.a.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(letters[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
            b = []
            for i in self.b.encode(text):
                piece = self.b.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
            spelt = (" " + text).encode()
            if b"".join(t for _, t in a) != spelt or b"".join(t for _, t in b) != spelt:
                a, b = [], []
            self.docs.append((a, b, self.links(a, b)))
        self.counts = Counter((x, y) for _, _, links in self.docs for _, x, y in links)
        self.best = Counter()
        for (_, y), n in self.counts.items():
            self.best[y] = max(self.best[y], n)

    @staticmethod
    def links(a, b):
        def ends(tokens):
            at = 0
            for number, token in tokens:
                at += len(token)
                yield at, number

        other = dict(ends(b))
        return [(at, number, other[at]) for at, number in ends(a) if at in other]

    def row(self, doc):
        a, b, links = doc
        groups, at = [], [0, 0]
        for end, _, _ in links:
            part = []
            for side, tokens in enumerate((a, b)):
                first = at[side]
                while sum(len(t) for _, t in tokens[: at[side]]) < end:
                    at[side] += 1
                part.append(",".join(str(i) for i, _ in tokens[first : at[side]]))
            groups.append("|".join(part))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if links else ""
        own = [self.counts[x, y] for _, x, y in links]
        n_best = sum(self.counts[x, y] == self.best[y] for _, x, y in links)
        return (len(a), len(b), len(groups), len(links), n_best, sum(own), digest)


def awkward(n, seed):
    rng = random.Random(seed)
    words = ["token", "ization", "Schloß", "année", "the", "of", "12345", "x\n", "\t", "  ", "日本", "😀", "</s>", "<0x41>"]
    return ["".join(rng.choice([*words, " ", ", "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


TEXTS = [*awkward(60, 3), None, "", " ", "▁a", "a ﬁ b", "<|endoftext|> a", "same text", "same text", "ends "]


@pytest.mark.parametrize("limits", [{}, {"shard_keys": 9, "broadcast_bytes": 24 * 40}])
def test_rows_are_those_of_plain_loops(spark, documents_of, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(module, "PAIRS_HELD", 10)
        monkeypatch.setattr(module, "SEGMENT", 8)
    plain = Plain(TEXTS)
    df = documents_of(list(enumerate(TEXTS))).repartition(3)
    got = {r.doc_id: r for r in token_alignment(df, PATH_A, PATH_B, **limits).collect()}
    names = [f.name for f in OUT]
    for doc_id, doc in enumerate(plain.docs):
        assert tuple(got[doc_id][c] for c in names) == plain.row(doc), TEXTS[doc_id]
        assert hashlib.sha256(got[doc_id].groups.encode()).hexdigest() == got[doc_id].groups_sha256 or not doc[0]


def test_query_against_plain_loops(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    plain = Plain([r.text for r in rows])
    want = {r.doc_id: doc for r, doc in zip(rows, plain.docs, strict=True)}
    got = op13_token_alignment(spark, small_dir).collect()
    assert len(got) == len(want)
    for row in got:
        doc = want[row.doc_id]
        if len(doc[0]) < 500:
            assert tuple(row[1:]) == plain.row(doc)
        else:
            assert (row.n_a, row.n_b, row.n_links) == tuple(map(len, doc))


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, np.uint64))
        hash_ = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
        assert sorted(hash_.numbers(keys).tolist()) == list(range(len(keys)))
        if n > 1000:
            assert 8 * len(hash_.to_bytes()) < 6 * n
            assert (hash_.numbers(rng.integers(0, 2**63, 1000, np.uint64)) < len(keys)).all()


def test_shards_keep_the_pairs_of_an_id_together():
    assert shard_starts([(1, 4), (2, 3), (5, 9), (6, 1)], 8) == ([1, 5, 6], [7, 9, 1])
    assert shard_starts([], 8) == ([], [])


def test_null_ids_clashing_columns_long_text_and_empty_table(spark, documents_of):
    long = "word by word, " * 40_000
    df = documents_of([(None, "a b"), (3, long), (3, long)])
    df = df.withColumnRenamed("lang", "n_best").withColumnRenamed("source", "ids_a")
    got = sorted(token_alignment(df, PATH_A, PATH_B).collect(), key=lambda r: r.n_a)
    assert [r.doc_id for r in got] == [None, 3, 3] and got[1] == got[2]
    assert got[0].ids_a == "s" and got[0].n_links == 2
    assert got[1].n_a > 150_000 and got[1].count_sum > got[1].n_links
    empty = token_alignment(df.limit(0), PATH_A, PATH_B)
    assert empty.count() == 0 and "groups_sha256" in empty.columns
