"""Statistics against brute force; votes against labels and planted kinds."""

import random
import re
from collections import Counter

import numpy as np

import markwise.llm.quality_rules as module
from markwise.llm.batches import table
from markwise.llm.quality_rules import (
    RULES,
    accuracies,
    fit_votes,
    op1_quality_rules,
    quality_rules,
    text_statistics,
    vote_pattern,
)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside))


def check(rows, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {i: brute(t) for i, t in texts.items()}


def test_statistics_of_awkward_texts(spark, documents_of):
    rng = random.Random(3)
    texts = {i: "".join(rng.choice(" \n\t\x0b\x1c\x85 ab*|é日") for _ in range(rng.randint(0, 80))) for i in range(300)}
    texts |= {900: None, 901: "", 902: " \n ", 903: "a b c a b c a b", 904: "x\nx\nx\r\n\n\n", 905: "w " * 30000}
    check(text_statistics(documents_of(list(texts.items()))).collect(), texts)


def test_given_table(spark, small_dir):
    texts = {r.doc_id: r.text for r in table(spark, small_dir, "documents").select("doc_id", "text").collect()}
    rows = op1_quality_rules(spark, small_dir).collect()
    check(rows, texts)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_verdicts_agree_with_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality_rules(table(spark, folder, "documents"), keep=["doc_id"]).select("doc_id", "p_good")
    rows = judged.join(table(spark, folder, "labels"), "doc_id").collect()
    clean = [r.p_good >= 0.5 for r in rows if r.quality == 1]
    junk = [r.p_good < 0.5 for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) > 0.95


def test_em_recovers_rates_of_a_mixture():
    rng, n = np.random.default_rng(1), 20000
    kind = rng.choice(4, n, p=[0.85, 0.05, 0.05, 0.05])  # 0 good, else bad by one of three rules
    chance = np.array([[0.01, 0.01, 0.01], [0.9, 0.1, 0.1], [0.1, 0.9, 0.1], [0.1, 0.1, 0.9]])[kind]
    votes = np.where(rng.random((n, 3)) < 0.2, 0, np.where(rng.random((n, 3)) < chance, 1, 2))
    patterns, counts = np.unique((votes * 3 ** np.arange(3)).sum(1), return_counts=True)
    good, rates, share = fit_votes(patterns, counts, 3)
    assert abs(share - 0.85) < 0.05
    assert (accuracies(rates)[:, 0] > 0.7).all() and (accuracies(rates)[:, 1] > 0.97).all()
    assert dict(zip(patterns.tolist(), good.tolist()))[2 + 6 + 18] > 0.95
    assert dict(zip(patterns.tolist(), good.tolist()))[1 + 3 + 18] < 0.5


def test_nulls_repeats_clashing_columns_and_empty_table(spark, documents_of):
    df = documents_of([(1, None), (None, "word " * 60), (None, "word " * 60), (2, "")])
    df = df.withColumnRenamed("lang", "n_words").withColumnRenamed("source", "votes")
    rows = quality_rules(df).collect()
    assert len(rows) == 4 and all(0 <= r.p_good <= 1 for r in rows)
    assert {r.n_words for r in rows if r.doc_id is None} == {60}
    assert quality_rules(df.limit(0)).count() == 0
    assert text_statistics(df).select(vote_pattern(RULES[:2])).count() == 4


def plain_em(votes, rounds=500, strength=4.0):
    """The mixture text by text, with loops instead of counted patterns."""
    n_rules = len(votes[0])
    member = []
    for v in votes:
        said = [float(x == 1) for x in v]
        start = [float(not any(said)), *said]
        member.append([m / sum(start) for m in start])
    for _ in range(rounds):
        rates, share = [], []
        for c in range(n_rules + 1):
            row = []
            for r in range(n_rules):
                belief = 0.001 if c == 0 else 0.9 if c == r + 1 else module.OTHERS
                least = 0.0 if c == 0 else module.OWN if c == r + 1 else module.OTHERS
                said_bad = strength * belief + sum(m[c] for m, v in zip(member, votes) if v[r] == 1)
                said_good = strength * (1 - belief) + sum(m[c] for m, v in zip(member, votes) if v[r] == 2)
                row.append(max(least, said_bad / (said_bad + said_good)))
            rates.append(row)
            share.append((sum(m[c] for m in member) + 1) / (len(votes) + n_rules + 1))
        before, member = member, []
        for v in votes:
            like = []
            for c in range(n_rules + 1):
                p = share[c]
                for r in range(n_rules):
                    p *= {0: 1.0, 1: rates[c][r], 2: 1 - rates[c][r]}[v[r]]
                like.append(p)
            member.append([p / sum(like) for p in like])
        if max(abs(a - b) for x, y in zip(before, member) for a, b in zip(x, y)) < 1e-9:
            break
    return [m[0] for m in member], rates, share[0]


def test_em_over_patterns_equals_em_over_texts():
    rng = np.random.default_rng(5)
    votes = rng.choice(3, (200, 4), p=[0.2, 0.15, 0.65])
    codes = (votes * 3 ** np.arange(4)).sum(1)
    patterns, counts = np.unique(codes, return_counts=True)
    good, rates, share = fit_votes(patterns, counts, 4)
    want, want_rates, want_share = plain_em(votes.tolist())
    got = dict(zip(patterns.tolist(), good.tolist()))
    assert np.allclose([got[c] for c in codes.tolist()], want, atol=1e-6)
    assert np.allclose(rates, want_rates, atol=1e-6) and abs(share - want_share) < 1e-6


def test_a_rule_that_errs_alone_loses_its_weight_at_every_size():
    n_rules = len(RULES)
    for n, errs in ((1000, 0.05), (100_000, 0.05), (100_000, 0.2), (10_000, 0.01)):
        rng = np.random.default_rng(n)
        kind = rng.choice(4, n, p=[0.88, 0.04, 0.04, 0.04])  # 0 good, else junk that three rules notice
        chance = np.full((4, n_rules), 0.002)
        chance[0, 0] = errs
        for k in (1, 2, 3):
            chance[k, [2 * k - 1, 2 * k, 7]] = 0.95
        votes = np.where(rng.random((n, n_rules)) < chance[kind], 1, 2)
        codes = (votes * 3 ** np.arange(n_rules)).sum(1)
        patterns, counts = np.unique(codes, return_counts=True)
        good, rates, _ = fit_votes(patterns, counts, n_rules)
        kept = good[np.searchsorted(patterns, codes)] >= 0.5
        accused = (kind == 0) & (votes[:, 0] == 1)
        assert kept[accused].mean() >= 0.95 and kept[kind == 0].mean() > 0.99, (n, errs)
        assert (~kept[kind > 0]).mean() >= 0.95, (n, errs)
        assert abs(rates[0, 0] - (votes[kind == 0, 0] == 1).mean()) < 0.02


def test_long_texts_count_windows_alike(monkeypatch):
    rng = random.Random(8)
    words = [rng.choice([b"a", b"b", b"c", b"dd", b"e5"]) for _ in range(400)]
    want = module.repeat_words(words)
    monkeypatch.setattr(module, "MANY_WORDS", 0)
    assert module.repeat_words(words) == want == brute(b" ".join(words).decode())[4]
    assert [module.repeat_words([b"x"] * n) for n in range(5)] == [0, 0, 0, 0, 4]


def test_a_line_of_marks_does_not_condemn_a_text(spark, documents_of):
    plain = [(i, " ".join(f"w{(i * 7 + j) % 97}x{j}" for j in range(80))) for i in range(200)]
    ruled = [(1000 + i, t + "\n" + "*" * 40) for i, t in plain[:10]]
    marked = [(2000 + i, " ".join(w + "&&&" for w in t.split())) for i, t in plain[:10]]
    rows = quality_rules(documents_of(plain + ruled + marked), keep=["doc_id"]).collect()
    assert {r.doc_id for r in rows if r.p_good < 0.5} == {i for i, _ in marked}
