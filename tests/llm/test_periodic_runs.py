"""Runs against all stretches and periods tried one by one."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from markwise.llm.periodic_runs import (
    RUNS,
    Factors,
    RangeSuccessor,
    op12_periodic_runs,
    periodic_runs,
    rewritten,
    runs_of_texts,
)


def plain_runs(words):
    """Every (start, length, period), by definition."""
    n, found = len(words), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                start, length = i, j + q - i
                if length >= max(24, 3 * q):
                    smallest = next(
                        p for p in range(1, q + 1) if words[start : start + length - p] == words[start + p : start + length]
                    )
                    if smallest == q:
                        found.add((start, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(words):
    rows = plain_runs(words)
    best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in rows for i in range(s + q, s + n)}
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    return (
        len(rows), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest(),
    )


def repetitive(rng, size):
    """Words of repetitions within repetitions, cut and disturbed."""
    words = []
    while len(words) < size:
        unit = [rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 30]))]
        for _ in range(rng.randint(0, 2)):
            unit = unit * rng.randint(1, 5) + [rng.choice("abxyz") for _ in range(rng.randint(0, 3))]
        words += (unit * rng.randint(1, 7))[: rng.randint(1, 400)]
        words += [f"u{rng.randint(0, 50)}" for _ in range(rng.randint(0, 12))]
    return words[:size]


def encoded(texts):
    return [[w.encode() for w in words] for words in texts]


def test_runs_are_all_runs():
    rng = random.Random(4)
    texts = [repetitive(rng, rng.randint(0, 500)) for _ in range(150)]
    got = runs_of_texts(encoded(texts))
    assert sum(map(len, got)) > 300
    for words, rows in zip(texts, got, strict=True):
        assert [tuple(r) for r in rows.tolist()] == plain_runs(words), words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=40), st.integers(1, 9)), max_size=6))
def test_runs_of_two_letters(parts):
    words = [c for unit, times in parts for c in unit * times]
    (got,) = runs_of_texts(encoded([words]))
    assert [tuple(r) for r in got.tolist()] == plain_runs(words)


def test_fibonacci_words_and_one_repeated_word():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    for words in (list(b), ["x"] * 700, list(b[:200]) * 4):
        (got,) = runs_of_texts(encoded([words]))
        assert [tuple(r) for r in got.tolist()] == plain_runs(words)


def test_range_successor_and_common_extensions():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    found = RangeSuccessor(values)
    low = rng.integers(0, 300, 500)
    high = np.minimum(low + rng.integers(0, 80, 500), 300)
    bound = rng.integers(0, 320, 500)
    want = [min((v for v in values[x:y] if v >= z), default=300) for x, y, z in zip(low, high, bound, strict=True)]
    assert found.find(low, high, bound).tolist() == want
    items = np.concatenate([[8], rng.integers(0, 2, 400), [9]])
    a, b = rng.integers(1, 401, 300), rng.integers(1, 401, 300)
    a, b = a[a != b], b[a != b]
    factors = Factors(items)
    for x, y, after, before in zip(a, b, factors.agree_from(a, b), factors.agree_before(a, b), strict=True):
        assert after == next(t for t in range(500) if items[x + t] != items[y + t])
        assert before == next(t for t in range(500) if items[x - 1 - t] != items[y - 1 - t])


def test_rewritten_tails_follow_the_rule():
    for doc_id in range(400):
        words = [f"w{i}".encode() for i in range(doc_id % 90)]
        h = zlib.crc32(str(doc_id).encode())
        want = list(words)
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        assert rewritten(words, doc_id) == want


@pytest.mark.parametrize("batch_words", [1, 700, 200_000])
def test_batches_do_not_matter(spark, documents_of, batch_words):
    rng = random.Random(8)
    texts = {i: " ".join(repetitive(rng, rng.randint(0, 300))) for i in range(40)}
    got = periodic_runs(documents_of(list(texts.items())), batch_words=batch_words).collect()
    names = [f.name for f in RUNS][:7]
    for row in got:
        words = texts[row.doc_id].split()
        assert tuple(row[c] for c in names) == plain_row(words)
        assert [tuple(r) for r in row.runs] == plain_runs(words)
        assert hashlib.sha256(row.collapsed.encode()).hexdigest() == row.collapsed_sha256


def test_query_against_all_periods(spark, small_dir):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = op12_periodic_runs(spark, small_dir).collect()
    assert len(got) == len(documents) and any(r.n_runs for r in got)
    for row in got:
        words = [w.decode() for w in rewritten((documents[row.doc_id] or "").encode().split(), row.doc_id)]
        if len(words) < 1500:
            assert tuple(row[1:]) == plain_row(words), row.doc_id


def test_null_empty_repeated_clashing_and_long_texts(spark, documents_of):
    long = " ".join(["one two three"] * 30_000) + " end " + " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a " * 30), (7, None), (7, ""), (7, " \t\n"), (8, "b " * 24), (8, "b " * 24), (9, long)]
    df = documents_of(rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "i0")
    got = {str(r.doc_id): r for r in periodic_runs(df, keep=["doc_id", "runs", "i0"]).collect()}
    assert got["None"].period == 1 and got["None"].length == 30 and got["None"].collapsed == "a"
    assert got["7"].n_runs == 0 and got["7"].start is None and got["7"].exponent_milli is None
    assert got["7"].collapsed_sha256 == hashlib.sha256(b"").hexdigest() and got["7"].i0 == "s"
    assert (got["8"].start, got["8"].length, got["8"].exponent_milli) == (0, 24, 24000)
    assert (got["9"].start, got["9"].length, got["9"].period) == (0, 90_000, 3)
    assert len(got["9"].collapsed.split()) == 60_004
    assert periodic_runs(df.limit(0)).count() == 0
