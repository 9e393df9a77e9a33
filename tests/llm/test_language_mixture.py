"""Languages of held-out texts, mixtures, and defined results."""

import zlib

import numpy as np

from markwise.llm.batches import table
from markwise.llm.language_mixture import MixtureReader, fit_languages, held_out, identify, op7_language_id

SF = "/root/testdata/sf0.01"


def models_of(spark):
    documents = table(spark, SF, "documents").filter(~held_out("doc_id"))
    return fit_languages(documents, "text", "lang", "doc_id")


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    rows = op7_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 250 and np.mean(held) > 0.98


def test_shares_of_mixed_texts(spark):
    """Texts put together from two held-out texts show both, by their words."""
    reader = MixtureReader(models_of(spark))
    texts = {}
    for r in table(spark, SF, "documents").filter(held_out("doc_id")).filter("n_chars > 1500").orderBy("doc_id").collect():
        texts.setdefault(r.lang, r.text.split()[:200])
    names = sorted(texts)
    for one in names:
        for other in names:
            if one != other:
                mixed = " ".join(texts[one][:150] + texts[other][:50])
                (shares,) = reader.infer([mixed])
                assert list(shares)[0] == one and set(shares) == {one, other}
                assert abs(shares[one] - 0.75) < 0.2


def test_sample_bounds_what_is_learned_from(spark):
    documents = table(spark, SF, "documents")
    few = fit_languages(documents, "text", "lang", "doc_id", per_language=5)
    assert few.languages == ["de", "en", "es", "fr"]
    assert len(few.trigrams) < len(models_of(spark).trigrams)


def test_defined_results(spark, documents_of):
    models = models_of(spark)
    df = documents_of([(1, None), (2, ""), (3, "12 !? ½"), (None, "the of and that with"), (None, "the of and that with"), (5, "é" * 5000)])
    df = df.withColumnRenamed("lang", "score").withColumnRenamed("source", "lang_pred")
    rows = identify(df, models).collect()
    assert [(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in rows if r.doc_id is None] == ["en", "en"]
    assert identify(df.limit(0), models).count() == 0
    nothing = fit_languages(df.limit(0), "text", "lang_pred", "doc_id")
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
