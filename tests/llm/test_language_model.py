"""Scores against brute-force counting; probabilities sum to one."""

import math
import random
import zlib
from collections import Counter

import numpy as np

import markwise.llm.language_model as module
from markwise.llm.backoff_automaton import build
from markwise.llm.batches import table
from markwise.llm.language_model import op9_language_model, score_documents, spelt


def words_of(text):
    raw = (text or "").encode().lower().split()
    return [*raw, None]


def brute(texts, frequent=module.FREQUENT, kept=module.KEPT, discount=module.DISCOUNT):
    """(n_known, base, score) of each text by dictionaries of whole n-grams."""
    train = [words_of(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for line in train for w in line)
    total, distinct = sum(count.values()), len(count)

    def unigram(w):
        return (count[w] + 0.5) / (total + 0.5 * (distinct + 1))

    own = {w for w, n in count.items() if n >= max(2, total * frequent)} | {"<s>"}
    lines = [["<s>", *line] for line in train]
    grams = {1: {(w,): count[w] for w in own - {"<s>"}} | {("<s>",): len(lines)}}
    for order in (2, 3):
        seen = Counter(tuple(line[i : i + order]) for line in lines for i in range(len(line) - order + 1))
        lower = grams[order - 1]
        grams[order] = {
            g: n for g, n in seen.items() if n >= max(2, total * kept) and g[:-1] in lower and g[1:] in lower
        }
    after = {}
    for order in (2, 3):
        for g in grams[order]:
            after.setdefault(g[:-1], []).append(g[-1])

    def prob(history, w):
        if not history:
            return unigram(w)
        if history not in after:
            return prob(history[1:], w)
        n = grams[len(history) + 1].get((*history, w))
        if n:
            return (n - discount) / grams[len(history)][history]
        left = 1 - sum((grams[len(history) + 1][(*history, v)] - discount) / grams[len(history)][history] for v in after[history])
        lower = 1 - sum(prob(history[1:], v) for v in after[history])
        return left / lower * prob(history[1:], w)

    out = {}
    for i, t in texts.items():
        line, score, history = words_of(t), 0.0, ("<s>",)
        for w in line:
            score += math.log10(prob(history, w))
            history = (*history, w)[-2:] if w in own else ()
        out[i] = (sum(count[w] > 0 for w in line), sum(math.log10(unigram(w)) for w in line), score)
    return out, total


def sample(seed, n=60):
    rng = random.Random(seed)
    return {i: " ".join(rng.choice(["the", "The", "of", "a", "cat", "sat", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 40))) for i in range(n)}


def compare(rows, texts, **options):
    want, total = brute(texts, **options)
    assert len(rows) == len(texts)
    for r in rows:
        known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words_of(texts[r.doc_id])), known, total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6


def test_scores_equal_brute_force(spark, documents_of):
    texts = sample(1) | {100: None, 101: "", 102: " \n"}
    compare(score_documents(documents_of(list(texts.items())).repartition(3)).collect(), texts)


def test_blocks_and_pruning_change_nothing_but_the_model(spark, documents_of, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_DOCUMENTS", 7)
    monkeypatch.setattr(module, "CODES_AT_ONCE", 50)
    monkeypatch.setattr(module, "FREQUENT", 1 / 60)
    monkeypatch.setattr(module, "KEPT", 1 / 200)
    texts = sample(2)
    rows = score_documents(documents_of(list(texts.items())).repartition(2)).collect()
    compare(rows, texts, frequent=1 / 60, kept=1 / 200)


def test_rare_words_and_ngrams_stay_however_large_the_corpus(spark, documents_of):
    texts = sample(3) | {1000 + i: "filler " * 15000 for i in range(40)}
    rows = score_documents(documents_of(list(texts.items())).repartition(3)).collect()
    compare(rows, texts, frequent=0, kept=0)


def test_probabilities_of_every_state_sum_to_one():
    unigram = np.array([0, 0.2, 0.3, 0.1, 0.05])
    bigrams = np.array([[0, 2], [0, 3], [2, 3], [2, 1], [3, 2]])
    trigrams = np.array([[0, 2, 3], [2, 3, 2]])
    model = build(5, unigram, np.array([10, 0, 20, 15, 4]), [(bigrams, np.array([5, 4, 9, 6, 8])), (trigrams, np.array([3, 4]))], 0.75)
    rest = 1 - unigram.sum()  # words without a number
    for state in range(1, len(model.fail)):
        total = 10 ** model.weight_to_root[state] * rest
        for token in range(1, 5):
            at, weight = state, 0.0
            while at and (arc := model.arcs.get(at * 5 + token)) is None:
                weight += model.backoff[at]
                at = model.fail[at]
            total += 10 ** (weight + (arc[0] if at else math.log10(unigram[token])))
        assert abs(total - 1) < 1e-9
    assert spelt(np.array([7, 12]), 5, []).tolist() == [[1, 2], [2, 2]]


def test_model_beats_the_base_on_held_out_texts(spark, small_dir):
    rows = op9_language_model(spark, small_dir).collect()
    texts = {r.doc_id: r.text for r in table(spark, small_dir, "documents").select("doc_id", "text").collect()}
    compare(rows, texts)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_repeats_null_ids_no_training_texts_and_empty_table(spark, documents_of):
    rows = score_documents(documents_of([(None, "a b"), (None, "a b"), (2, "a")])).collect()
    assert len(rows) == 3 and all(r.train_tokens == 8 and not r.held_out for r in rows)
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = score_documents(documents_of([(only, "a b")])).collect()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)
    clash = documents_of([(1, "a")]).withColumnRenamed("lang", "held").withColumnRenamed("source", "block")
    assert score_documents(clash).count() == 1 and score_documents(clash.limit(0)).count() == 0


def test_pieces_of_a_line_are_walked_as_a_whole(monkeypatch):
    rng = np.random.default_rng(8)
    tokens = rng.integers(2, 7, 3000)
    unigram, seen = np.full(8, 0.05), np.full(8, 900)
    pairs = {(a, b) for a, b in rng.integers(2, 7, (18, 2)).tolist()} | {(0, 2), (0, 3)}
    triples = {(a, b, c) for a, b in pairs for c in range(2, 7) if (b, c) in pairs and (a + b + c) % 3}
    grams = lambda kept, n: (np.array(sorted(kept)), np.full(len(kept), n))
    model = build(8, unigram, seen, [grams(pairs, 60), grams(triples, 9)], 0.75)
    line = np.where(rng.random(3000) < 0.1, -1, tokens)
    line[[0, 1, 127, 128, 129, 400, 2999]] = model.begin
    alone = np.log10(rng.random(3000))
    want, state, arcs = [], 0, model.arcs
    for token, lone in zip(line.tolist(), alone.tolist(), strict=True):
        gain, after = 0.0, 0
        if token == model.begin:
            after = model.start[token]
        elif token < 0:
            gain = model.weight_to_root[state] + lone
        else:
            while state and state * 8 + token not in arcs:
                gain, state = gain + model.backoff[state], model.fail[state]
            weight, after = arcs[state * 8 + token] if state else (lone, model.start[token])
            gain += weight
        want.append(gain)
        state = after
    for piece in (1, 7, 128, 5000):
        monkeypatch.setattr("markwise.llm.backoff_automaton.PIECE", piece)
        assert np.allclose(model.walk(line, alone), want, atol=1e-12), piece


def test_histories_go_by_numbers_that_lie_close_together(spark, monkeypatch):
    """The sums of histories are asked for by keys of a few bits, alike in all blocks and apart for each history."""
    monkeypatch.setattr(module, "BLOCK_DOCUMENTS", 3)
    asked = []
    exchanged = module.exchanged

    def seen(rows, ask, *rest, **more):
        if more.get("owners") is False and "numbered" not in more:
            for row in rows.collect():
                asked.append(ask(row.asDict())[0])
        return exchanged(rows, ask, *rest, **more)

    monkeypatch.setattr(module, "exchanged", seen)
    texts = [(i, f"a b c d{i % 5} e f{i % 3} a b g{i}") for i in range(40)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    module.score_documents(rows).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(asked) > 5
    width = 2**64 // parts + 1
    for keys in asked:
        assert len(set(keys.tolist())) == len(keys) and (np.diff(keys.astype(object)) > 0).all()
        inside = [key % width for key in keys.tolist() if key != int(module.BEGIN_NUMBER)]
        # hashes would lie all over the range
        assert all(min(x, width - x) < 2**20 for x in inside)
