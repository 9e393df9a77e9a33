"""Weighted sampling against generalised Jaccard, edits against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from markwise.llm.batches import table
from markwise.llm.weighted_fingerprints import (
    WeightedSampler,
    compared_with_edits,
    edited,
    fingerprints,
    likeness,
    op5_document_fingerprints,
)


def jaccard(one, other):
    a, b = Counter(one.split()), Counter(other.split())
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_samples_agree_as_often_as_weights_do():
    rng, sampler, errors = random.Random(4), WeightedSampler(512), []
    for _ in range(60):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(40)]
        one, other = ([w for w in words for _ in range(rng.choice([0, 1, 2, 7]))] for _ in range(2))
        one, other = " ".join(one), " ".join(other)
        prints = sampler.of([one.encode(), other.encode()])
        errors.append(likeness(*prints) - jaccard(one, other))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def expected(texts):
    """(n_chars, sha of the edited text, similarities) by id, descending."""
    order = sorted(texts, reverse=True)
    out = {}
    for i, key in enumerate(order):
        own, following = texts[key] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(own) // 2
        edit = own[: len(own) - half] + following[:half]
        out[key] = (len(own), hashlib.sha256(edit.encode()).hexdigest(), jaccard(own, edit), jaccard(own, following))
    return out


def compare(rows, texts):
    want = expected(texts)
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        assert abs(r.near_edited - want[r.doc_id][2]) < 0.4 and abs(r.near_next - want[r.doc_id][3]) < 0.4
    assert abs(np.mean([r.near_edited - want[r.doc_id][2] for r in rows])) < 0.06


def test_whole_table(spark, small_dir):
    texts = {r.doc_id: r.text for r in table(spark, small_dir, "documents").select("doc_id", "text").collect()}
    compare(op5_document_fingerprints(spark, small_dir).collect(), texts)


def test_order_across_parts(spark, documents_of):
    texts = {i * 7 % 211: f"é text {i} of some words {'x ' * (i % 9)}" for i in range(60)}
    texts |= {900: None, 901: "", 902: "a", 903: "日本"}
    compare(compared_with_edits(documents_of(list(texts.items())).repartition(5)).collect(), texts)


def test_single_row_repeated_rows_nulls_and_empty_table(spark, documents_of):
    (row,) = compared_with_edits(documents_of([(3, "one two three")])).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(edited("one two three", "one two three").encode()).hexdigest()
    rows = compared_with_edits(documents_of([(3, "a b"), (3, "a b"), (None, "a b"), (None, None), (1, "c d")])).collect()
    assert len(rows) == 5
    assert len({r.fingerprint for r in rows if r.n_chars == 3 and r.doc_id != 1}) == 1
    assert compared_with_edits(documents_of([(1, "a")]).limit(0)).count() == 0
    clash = documents_of([(1, "a")]).withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "id")
    assert fingerprints(clash).first().fingerprint != "en" and compared_with_edits(clash).count() == 1
