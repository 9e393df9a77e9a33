"""Language identification by mixture inference.

Every language has a letter-trigram model, counted by Spark on a sample of the
labelled documents of at most about ``SAMPLE_PER_LANGUAGE`` whole documents a
language (chosen by a hash of the id; all of them where there are fewer). A
document is a mixture of languages: expectation-maximisation estimates their
proportions from the likelihoods of its words, and languages are added, the
largest proportion first, as long as the likelihood gains more than a penalty
that grows with the logarithm of the document's length.

Defined results: ``und`` with score 0 and no languages for a text that is null
or has no letter, and for all texts if nothing can be learned from. Ties go to
the language that comes first by name. The same text always gets the same
result. The score is the share of the predicted language in the document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, emit, table

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SAMPLE_PER_LANGUAGE = 3000
SMOOTHING = 0.2
#: Nats a further language must gain at least, and per log of the word count.
LEAST_GAIN, GAIN_PER_LOG = 6.0, 2.0
SHARE_ROUNDS = 30
DOCUMENTS_AT_ONCE = 256
MEMO_BYTES = 64 << 20
NONE = "und"


@dataclass
class TrigramModels:
    """Rows of log-probabilities by language: of trigrams, and of an unseen
    letter after two seen ones. Row 0 is all zeros (nothing known)."""

    languages: list[str]
    trigrams: dict[str, int]
    pairs: dict[str, int]
    logs: np.ndarray


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def trigram_counts(samples: DataFrame) -> DataFrame:
    """(lang, gram, n) over samples (lang, text); summed per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, seen in words.items():
            grams: Counter = Counter()
            for word, n in seen.items():
                padded = f" {word} "
                for i in range(len(padded) - 2):
                    grams[padded[i : i + 3]] += n
            rows = [(lang, gram, n) for gram, n in grams.items()]
            yield emit(["lang", "gram", "n"], [pa.string(), pa.string(), pa.int64()], rows)

    counted = samples.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_languages(df: DataFrame, text: str, lang: str, sample_by: str, per_language: int = SAMPLE_PER_LANGUAGE) -> TrigramModels:
    """Trigram models of the languages of ``df``'s labelled rows.

    What reaches the driver is bounded by the sample, not by the corpus.
    """
    labelled = df.filter(df[lang].isNotNull() & df[text].isNotNull()).select(
        df[lang].alias("lang"), df[text].alias("text"), F.pmod(F.xxhash64(df[sample_by].cast("string")), F.lit(1 << 20)).alias("place")
    )
    sizes = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for name, size in sorted(sizes.items()):
        chosen |= (F.col("lang") == name) & (F.col("place") < int((1 << 20) * min(1.0, per_language / size)))
    found = trigram_counts(labelled.filter(chosen)).collect() if sizes else []
    languages = sorted({row["lang"] for row in found})
    place = {name: i for i, name in enumerate(languages)}
    grams = sorted({row["gram"] for row in found})
    number = {gram: i for i, gram in enumerate(grams)}
    counts = np.zeros((len(grams), len(languages)))
    for row in found:
        counts[number[row["gram"]], place[row["lang"]]] = row["n"]
    heads = sorted({gram[:2] for gram in grams})
    head_number = {head: i for i, head in enumerate(heads)}
    of_head = np.array([head_number[gram[:2]] for gram in grams], np.int64)
    totals = np.zeros((len(heads), len(languages)))
    np.add.at(totals, of_head, counts)
    letters = len({gram[2] for gram in grams}) + 1
    norms = totals + SMOOTHING * letters
    logs = np.zeros((1 + len(grams) + len(heads), len(languages)))
    logs[1 : 1 + len(grams)] = np.log((counts + SMOOTHING) / norms[of_head]) if grams else 0
    logs[1 + len(grams) :] = np.log(SMOOTHING / norms)
    return TrigramModels(
        languages,
        {gram: i + 1 for gram, i in number.items()},
        {head: i + 1 + len(grams) for head, i in head_number.items()},
        logs,
    )


class MixtureReader:
    """Infers language proportions, some hundred documents at a time."""

    def __init__(self, models: TrigramModels):
        self.models = models
        self.memo: dict[str, int] = {}
        width = max(1, len(models.languages))
        self.bound = MEMO_BYTES // (8 * width)
        self.known = np.zeros((1024, width))

    def rows_of(self, words: set[str]) -> None:
        """Adds the log-likelihood rows of words not seen before."""
        new = [word for word in words if word not in self.memo]
        if not new:
            return
        trigrams, pairs = self.models.trigrams.get, self.models.pairs.get
        flat: list[int] = []
        starts = []
        for word in new:
            starts.append(len(flat))
            padded = f" {word} "
            flat += [trigrams(padded[i : i + 3]) or pairs(padded[i : i + 2], 0) for i in range(len(padded) - 2)]
        fresh = np.add.reduceat(self.models.logs[np.array(flat)], np.array(starts), axis=0)
        base = len(self.memo)
        if base + len(new) > len(self.known):
            grown = np.zeros((max(2 * len(self.known), base + len(new)), self.known.shape[1]))
            grown[:base] = self.known[:base]
            self.known = grown
        self.known[base : base + len(new)] = fresh
        self.memo.update(zip(new, range(base, base + len(new)), strict=True))

    def shares(self, ratio: np.ndarray, n: np.ndarray, starts: np.ndarray, allowed: np.ndarray):
        """EM for the proportions of the allowed languages of each document.

        ``ratio`` are word likelihoods relative to the word's best language.
        Returns proportions and log-likelihoods in the same measure.
        """
        lengths = np.diff(np.append(starts, len(n)))
        doc = np.repeat(np.arange(len(starts)), lengths)
        totals = np.add.reduceat(n, starts)
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(SHARE_ROUNDS):
            part = share[doc] * ratio
            part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
            new = np.add.reduceat(part, starts, axis=0) / totals[:, None]
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-4:
                break
        like = np.maximum((share[doc] * ratio).sum(1), 1e-300)
        return share, np.add.reduceat(n * np.log(like), starts)

    def infer(self, texts: list[str | None]) -> list[dict[str, float]]:
        """The languages of each text with their shares, largest first."""
        if len(self.memo) > self.bound:
            self.memo.clear()
        found: list[dict[str, float]] = [{} for _ in texts]
        counted = [(i, Counter(words)) for i, t in enumerate(texts) if (words := words_of(t))]
        if not counted or not self.models.languages:
            return found
        self.rows_of({word for _, seen in counted for word in seen})
        memo = self.memo.__getitem__
        rows = np.array([r for _, seen in counted for r in map(memo, seen)])
        n = np.array([c for _, seen in counted for c in seen.values()], float)
        starts = np.cumsum([0] + [len(seen) for _, seen in counted])[:-1]
        logs = self.known[rows]
        best = logs.max(1, keepdims=True)
        logs -= best
        ratio = np.exp(logs)
        width = len(self.models.languages)
        single = np.add.reduceat(n[:, None] * logs, starts, axis=0)
        everything, top = self.shares(ratio, n, starts, np.ones((len(starts), width)))
        penalty = LEAST_GAIN + GAIN_PER_LOG * np.log(np.add.reduceat(n, starts))
        share = np.eye(width)[single.argmax(1)]
        value = single.max(1)
        order = np.argsort(-everything, axis=1, kind="stable")
        lengths = np.diff(np.append(starts, len(n)))
        size = 2
        # no set of languages gains more than all of them together
        open_ = np.flatnonzero(top - value > penalty) if width > 1 else np.empty(0, int)
        while len(open_) and size <= width:
            allowed = np.zeros((len(open_), width))
            np.put_along_axis(allowed, order[open_, :size], 1.0, axis=1)
            at = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for d in open_])
            begins = np.cumsum(np.append(0, lengths[open_]))[:-1]
            new, like = self.shares(ratio[at], n[at], begins, allowed)
            better = like - penalty[open_] * (size - 1) > value[open_]
            share[open_[better]] = new[better]
            value[open_[better]] = (like - penalty[open_] * (size - 1))[better]
            open_ = open_[top[open_] - penalty[open_] * size > value[open_]]
            size += 1
        for (i, _), row in zip(counted, share, strict=True):
            ranked = np.argsort(-row, kind="stable")
            found[i] = {self.models.languages[k]: float(row[k]) for k in ranked if row[k] > 0}
        return found


PREDICTED = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType(), False)),
    ]
)


def identify(df: DataFrame, models: TrigramModels, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df[keep]`` with lang_pred, score and the shares of all its languages."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    def make():
        reader = MixtureReader(shared.value)

        def work(column):
            texts = column.to_pylist()
            found: list[dict[str, float]] = []
            for i in range(0, len(texts), DOCUMENTS_AT_ONCE):
                found += reader.infer(texts[i : i + DOCUMENTS_AT_ONCE])
            first = [next(iter(f.items()), (NONE, 0.0)) for f in found]
            return [[f[0] for f in first], [min(1.0, f[1]) for f in first], [list(f.items()) for f in found]]

        return work

    return add_columns(df, [text], PREDICTED, make, keep)


def held_out(id: str, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``, is 1 (null id: false)."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % folds == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    models = fit_languages(documents.filter(~held_out("doc_id")), "text", "lang", "doc_id")
    return identify(documents, models, keep=["doc_id"]).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "lang_pred",
        "score",
        F.size("lang_shares").alias("n_languages"),
    )
