"""Near duplicates against brute force on full sets."""

import random

import numpy as np
import pytest

from markwise.llm.near_duplicates import OnePermutation, banding, block_links, near_duplicates
from markwise.llm.words import WordHashes, shingles_of


def brute(texts, percent):
    """Component of each id, by comparing all pairs."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    while True:
        before = dict(root)
        for a in sets:
            for b in sets:
                common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if union and 100 * common >= percent * union:
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root, {i: len(s) for i, s in sets.items()}


def families(seed, n_bases=4, copies=30):
    """Copies with edits around the threshold, so that stars alone lose links."""
    rng = random.Random(seed)
    texts = {}
    for base in range(n_bases):
        words = [f"w{base}x{rng.randint(0, 500)}" for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 9)}"
            texts[len(texts) * 3 + 1] = " ".join(own)
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_components_are_those_of_all_pairs(spark, documents_of, percent):
    texts = families(percent)
    extra = ["", None, "  \n ", "Short text", "short  TEXT", "a b c d", "a b c d", "one two three four five"]
    texts |= {1000 + i: t for i, t in enumerate(extra)}
    roots, sizes = brute(texts, percent)
    got = near_duplicates(documents_of(list(texts.items())), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (sizes[i], roots[i], roots[i] == i) for i in texts
    }


def test_blocks_find_what_stars_cannot(monkeypatch, spark, documents_of):
    import markwise.llm.near_duplicates as module

    monkeypatch.setattr(module, "BLOCK_NODES", 7)
    texts = families(3, n_bases=2, copies=25)
    roots, _ = brute(texts, 85)
    got = near_duplicates(documents_of(list(texts.items()))).collect()
    assert {r.doc_id: r.component_id for r in got} == roots


def test_block_links_are_a_forest_of_true_links():
    hashes = WordHashes()
    texts = families(9, n_bases=1)
    sets = [shingles_of(t.encode(), hashes) for t in texts.values()]
    nodes = np.arange(len(sets))
    links = block_links(nodes, nodes, np.zeros(len(sets)), sets, 85)
    assert len(links) < len(sets)
    for a, b in links:
        common = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common)


def test_signatures_collide_as_often_as_sets_agree():
    rng = np.random.default_rng(5)
    method = OnePermutation(32, 6)
    for shared, own in ((900, 100), (60, 10), (12, 2)):
        same = []
        for _ in range(60):
            common = rng.integers(0, 2**64, shared, np.uint64)
            sets = [np.unique(np.append(common, rng.integers(0, 2**64, own, np.uint64))) for _ in range(2)]
            same.append((method.signature(sets[0]) == method.signature(sets[1])).mean())
        assert abs(np.mean(same) - shared / (shared + 2 * own)) < 0.04


def test_banding_misses_at_most_one_in_a_million():
    for percent in (80, 85, 95):
        bands, rows = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_null_ids_repeated_rows_clashing_columns_and_empty_table(spark, documents_of):
    df = documents_of([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, None)])
    df = df.withColumnRenamed("lang", "digest").withColumnRenamed("source", "kept")
    got = near_duplicates(df, keep=["doc_id", "text"])
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got.collect()) == [
        ("5", "5", True), ("5", "5", True), ("9", "5", False), ("None", "None", True), ("None", "None", True),
    ]
    assert near_duplicates(df.limit(0)).count() == 0
