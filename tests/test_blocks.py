"""Vectors are sent once per block of texts and word, not once per text and word."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from markwise.operators import alignment, embedding
from markwise.operators.assignment import best_assignment, unit_rows
from markwise.session import written


def _vocabulary(spark, n=30, width=4):
    made = np.random.default_rng(5).normal(size=(n, width)).astype("float32")
    return made, spark.createDataFrame([(f"w{i}", made[i].tolist()) for i in range(n)], "word string, vector array<float>")


def test_a_block_gets_each_word_once(spark):
    _, vocabulary = _vocabulary(spark)
    rows = spark.range(400).repartition(2).select("id", F.array(*[F.lit(f"w{i}") for i in range(25)], F.lit("odd")).alias("tokens"))

    def sizes(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table({"texts": [left.num_rows], "sent": [right.num_rows]})

    found = embedding.by_block(rows, ["tokens"], vocabulary, sizes, "texts bigint, sent bigint", 26 * 100).collect()
    assert sum(r.texts for r in found) == 400 and max(r.texts for r in found) <= 101
    assert [r.sent for r in found] == [25] * len(found)


def test_means_in_blocks_are_those_of_single_texts(spark, monkeypatch):
    monkeypatch.setattr(embedding, "SUMMED_WORDS", 7)
    made, vocabulary = _vocabulary(spark)
    rng = np.random.default_rng(6)
    texts = {i: [f"w{w}" for w in rng.integers(0, 40, rng.integers(0, 30))] for i in range(50)}
    texts[50] = None
    rows = spark.createDataFrame(list(texts.items()), "id int, tokens array<string>")
    got = {r.id: r for r in embedding.mean_vectors(rows, vocabulary, ["id"]).collect()}
    for i, tokens in texts.items():
        known = sorted({int(w[1:]) for w in tokens or [] if int(w[1:]) < 30})
        want = made[known].astype(float).mean(0) if known else np.zeros(4)
        assert got[i].n_known == len(known) and np.allclose(got[i].vector, want)
    # rows of one key count together, and so do two vectors of a word
    twice = embedding.mean_vectors(rows.unionByName(rows), vocabulary.unionByName(vocabulary), ["id"]).collect()
    assert all(r.n_known == 4 * got[r.id].n_known and np.allclose(r.vector, got[r.id].vector) for r in twice)


def test_alignments_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIR_WORDS", 20)
    made, vocabulary = _vocabulary(spark)
    units = unit_rows(made.astype(float))
    rng = np.random.default_rng(7)
    texts = [(i, "l", [f"w{w}" for w in rng.choice(20, 6, replace=False)]) for i in range(30)]
    rows = spark.createDataFrame(texts, "k int, lesson string, tokens array<string>")
    ideals = spark.createDataFrame([("l", [f"w{w}" for w in range(20, 29)])], "lesson string, ideal_tokens array<string>")
    got = {r.k: r.alignment for r in alignment.word_alignment(rows, ideals, vocabulary, "k", ["lesson"], 4).collect()}
    for k, _, tokens in texts:
        weight = units[sorted(int(w[1:]) for w in tokens)] @ units[20:29].T
        assert abs(got[k] - best_assignment(weight) / 9) < 1e-9


def test_known_words_send_a_vector_once_a_block(spark, monkeypatch):
    rows = [("a", 1, ["wax", "heat", "wax", "nowhere"]), ("a", 2, []), (None, 3, ["heat"]), ("b", 1, None), ("b", 2, ["zinc", "heat"])]
    texts = spark.createDataFrame(rows, "g string, seat bigint, tokens array<string>").repartition(1)
    vectors = [("heat", [1.0, 2.0]), ("wax", [5.0, 0.5]), ("wax", [3.0, 4.0]), ("zinc", [7.0, 8.0]), ("void", None)]
    vocabulary = spark.createDataFrame(vectors, "word string, vector array<float>")
    found = embedding.known_words(texts, vocabulary, ["g", "seat"])
    assert "_salt" not in found._jdf.queryExecution().toString()
    assert {(r.g, r.seat): (r.known_words, r.known_vectors) for r in found.collect()} == {
        ("a", 1): (["heat", "wax", "wax"], [1.0, 2.0, 3.0, 4.0, 5.0, 0.5]), ("a", 2): ([], []), (None, 3): (["heat"], [1.0, 2.0]),
        ("b", 1): ([], []), ("b", 2): (["heat", "zinc"], [1.0, 2.0, 7.0, 8.0])}


def test_vocabulary_joined_by_hash_is_the_one_joined_by_word(spark):
    rows = [(i, w) for i in range(40) for w in ("heat", "wax", None, f"made{i}")]
    words = spark.createDataFrame(rows, "id bigint, word string")
    vectors = [("heat", [1.0]), ("wax", [2.0]), ("wax", [3.0]), (None, [4.0]), ("made7", [5.0])]
    vocabulary = spark.createDataFrame(vectors, "word string, vector array<float>")
    for how in ("inner", "left"):
        joined = [embedding.join_vocabulary(words, vocabulary, "id", limit, how) for limit in (1 << 20, 0)]
        assert joined[0].columns == joined[1].columns
        assert sorted(map(str, joined[0].collect())) == sorted(map(str, joined[1].collect()))
    plan = joined[1]._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(word" in plan


def test_pairs_of_a_block_are_laid_out_some_at_a_time(monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 4)
    rows = pa.table({"tokens": [["wax", "heat"]] * 10, "ideal_tokens": [["zinc"]] * 10})
    known = pa.table({"word": ["wax", "zinc"], "vector": [[1.0, 0.0], [0.6, 0.8]]})
    assert [len(some) for some in alignment._sides(rows, known, 2)] == [4, 4, 2]
    scored = alignment._score_block(2, [])(rows, known)["alignment"].to_pylist()
    assert np.allclose(scored, [0.6] * 10)


def test_means_of_unique_keys_are_those_of_any_keys(spark):
    rows = spark.createDataFrame(
        [(1, ["a", "b", "a"]), (2, ["x"]), (3, []), (4, None), (5, ["c", "b"])], "id long, tokens array<string>")
    vocabulary = written(spark.createDataFrame(
        [("a", [1.0, -0.0]), ("b", [0.1, 2.0]), ("c", [3.0, 4.0]), ("c", [5.0, 6.0])], "word string, vector array<float>"), "vocabulary")
    found = embedding.mean_vectors(rows, vocabulary, ["id"], unique=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, embedding.mean_vectors(rows, vocabulary, ["id"]).collect()))
    # what follows the blocks deals out no vectors
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
