"""The join against all pairs on full sets, and its filters."""

import random

import numpy as np
import pytest

import markwise.llm.jaccard_join as module
from markwise.llm.jaccard_join import jaccard_groups, least_common, matched, prefix_length


def brute(texts, percent, size):
    def grams(text):
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    sets = {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    while True:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root, {i: len(s) for i, s in sets.items()}


def families(seed, n_bases=5, copies=30):
    """Copies with edits around the threshold, of copies of copies, with common passages."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for base in range(n_bases):
        line = [f"w{base}x{rng.randint(0, 400)}" for _ in range(rng.choice([6, 25, 80, 200]))]
        if base % 2:
            line[:0] = passage
        for _ in range(copies):
            own = list(line)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                own = own[: -rng.randint(1, 4)] or own
            texts[len(texts) * 3 + 1] = " ".join(own)
            if rng.random() < 0.2:
                line = own  # chains: ends that are not near each other
    return texts


@pytest.mark.parametrize("percent, small", [(85, False), (70, False), (85, True)])
def test_components_are_those_of_all_pairs(spark, documents_of, monkeypatch, percent, small):
    if small:
        monkeypatch.setattr(module, "PROBES_AT_ONCE", 3)
        monkeypatch.setattr(module, "POSTINGS_AT_ONCE", 5)
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    texts = families(percent + small)
    extra = ["", None, "  \n ", "Short text", "short  TEXT", "a b c", "a b c", "one two three four", "One two three FOUR"]
    texts |= {1000 + i: t for i, t in enumerate(extra)}
    roots, sizes = brute(texts, percent, 4)
    got = jaccard_groups(documents_of(list(texts.items())).repartition(4), percent=percent, part_bits=3 if small else None)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {i: (sizes[i], roots[i]) for i in texts}


def test_blocks_of_any_size_give_the_same(spark, documents_of, monkeypatch):
    texts = families(11, n_bases=3)
    roots, _ = brute(texts, 85, 3)
    got = jaccard_groups(documents_of(list(texts.items())), size=3).collect()
    assert {r.doc_id: r.component_id for r in got} == roots


def test_prefixes_of_similar_sets_meet_whatever_the_order():
    rng = random.Random(1)
    for _ in range(500):
        x = set(rng.sample(range(60), rng.randint(1, 40)))
        y = {v for v in x if rng.random() < 0.95} | set(rng.sample(range(60), rng.randint(0, 2)))
        if not y or 100 * len(x & y) < 85 * len(x | y):
            continue
        assert len(x & y) >= least_common(85, len(x), len(y))
        heads = [set(sorted(s)[: prefix_length(np.array(len(s)), 85)]) for s in (x, y)]
        assert heads[0] & heads[1]


def test_filters_keep_every_link_at_its_first_common_gram():
    rng = random.Random(5)
    kept = dropped = 0
    for _ in range(3000):
        x = sorted(rng.sample(range(80), rng.randint(5, 60)))
        y = sorted({v for v in x if rng.random() < 0.93} | set(rng.sample(range(80), rng.randint(0, 6))))
        common = set(x) & set(y)
        if not common:
            continue

        def posting(number, s, at):
            rest = [sum(v % 8 == b for v in s[at + 1 :]) for b in range(8)]
            return (number, number, len(s), at, rest)

        first = min(common)
        found = matched([posting(1, x, x.index(first))], [posting(2, y, y.index(first))], 85)
        if 100 * len(common) >= 85 * len(set(x) | set(y)):
            kept += 1
            assert found == [(1, 2)]
        else:
            dropped += not found
    assert kept > 1000 and dropped > 500


def test_null_ids_repeated_rows_shared_ids_clashing_columns_and_empty_table(spark, documents_of):
    other = "v1 v2 v3 v4 v5 v6 v7"
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, None)]
    rows += [(9, other), (12, other + " "), (4, "")]
    df = documents_of(rows).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "digest")
    got = jaccard_groups(df, keep=["doc_id", "component_id", "digest"]).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.digest) for r in got) == [
        ("12", 4, "5", "s"), ("4", 0, "4", "s"), ("5", 3, "5", "s"), ("5", 3, "5", "s"), ("9", 3, "5", "s"),
        ("9", 4, "5", "s"), ("None", 0, "None", "s"), ("None", 3, "None", "s"),
    ]
    assert jaccard_groups(df.limit(0)).count() == 0


def test_long_texts(spark, documents_of):
    words = [f"w{i}" for i in range(150_000)]
    texts = {1: " ".join(words), 2: " ".join(words[:140_000]), 3: " ".join(words[:100_000])}
    got = jaccard_groups(documents_of(list(texts.items()))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {1: (149_997, 1), 2: (139_997, 1), 3: (99_997, 3)}


def test_occurrences_are_counted_at_their_places():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(40)
    assert module.occurrences(keys).tolist() == [int((keys == k).sum()) for k in keys]
    assert module.occurrences(keys[:0]).tolist() == []
