"""Counts against another library's unigram tokenizer and against all splits."""

import functools
import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from markwise.llm.batches import table
from markwise.llm.viterbi_counts import UnigramCounter, count_tokens, load_counter, op10_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def reference():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(len(model))]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return tokenizer


def awkward(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\tabelsthe1.,éß日€▁😀") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_counts_are_the_tokenizers():
    counter = load_counter(PATH)
    for text in awkward(1500, 1) + ["a", " a", "  a", "a ", "The end of it.\nNext  line"]:
        assert counter.count(text)[0] == len(reference().encode(text).ids), repr(text)


def test_best_score_is_the_best_of_all_splits():
    pieces = [("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -5.0), ("bc", -1.0), ("abc", -3.0)]
    counter = UnigramCounter(pieces, -5.0)
    scores = dict(pieces)

    @functools.cache
    def splits(text):
        if not text:
            return (0.0,)
        single = (scores.get(text[0], -15.0),)
        return tuple(
            s + r for n in range(1, len(text) + 1) for s in ([scores[text[:n]]] if text[:n] in scores else single if n == 1 else []) for r in splits(text[n:])
        )

    rng = random.Random(2)
    for _ in range(200):
        word = "▁" + "".join(rng.choice("abcx") for _ in range(rng.randint(0, 9)))
        assert counter.part(word)[1] == max(splits(word))
    # equal totals: the path whose last piece begins first
    assert counter.part("▁ab")[0] == 2


def test_given_texts(spark, small_dir):
    texts = {r.doc_id: r.text for r in table(spark, small_dir, "documents").select("doc_id", "text").collect()}
    got = op10_token_counts(spark, small_dir).collect()
    assert {r.doc_id: r.n_pieces for r in got} == {i: len(reference().encode(t).ids) for i, t in texts.items()}


def test_nulls_repeats_long_text_clashing_columns_and_empty_table(spark, documents_of):
    df = documents_of([(1, None), (1, ""), (None, "x y"), (None, "x y"), (5, "a" * 20000)]).withColumnRenamed("lang", "n_pieces")
    got = count_tokens(df, PATH, keep=["doc_id", "n_pieces", "text"]).collect()
    assert sorted(r.n_pieces for r in got)[:4] == [0, 0, 2, 2]
    assert count_tokens(df.limit(0), PATH).count() == 0
