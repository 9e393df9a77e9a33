"""Token counts under a unigram vocabulary, without making the tokens.

The tokenizer is a unigram model over the pieces and scores of a vocabulary
file: a text is cut at its spaces, every part begins with the space mark, and
each part is split into the pieces of greatest total score. Characters that no
piece covers cost ten less than the worst piece and count as their bytes.
Control, unknown and byte pieces never match text.

An Aho-Corasick automaton enumerates the pieces that end at each character;
dynamic programming carries the best score and its number of pieces to that
character. Ties go as in the tokenizer: of equal totals the one whose last
piece begins first wins, an uncovered character loses to any piece.

Null and empty texts have no pieces and score 0. Repeated rows and null ids
are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, table
from markwise.llm.chunked_encoding import vocabulary_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
LONGEST_MEMO = 40

COUNTED = T.StructType(
    [
        T.StructField("n_pieces", T.LongType()),
        T.StructField("best_score", T.DoubleType()),
        T.StructField("n_unknown", T.LongType()),
    ]
)


class UnigramCounter:
    """Counts pieces of texts; remembers parts it has counted, up to a bound."""

    def __init__(self, pieces: list[tuple[str, float]], worst: float, bound: int = 300_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN_PENALTY
        self.bound = bound
        self.known: dict[str, tuple[int, float, int]] = {}

    def part(self, text: str) -> tuple[int, float, int]:
        """(pieces, score, uncovered characters) of a part with its mark."""
        scores, counts, unknowns = [0.0], [0], [0]
        matches = self.automaton.iter(text)
        end, match = next(matches, (-1, None))
        for at in range(len(text)):
            best, count, unknown, single = None, 0, 0, False
            while end == at:  # the longest first
                length, score = match
                start = at + 1 - length
                total = scores[start] + score
                if best is None or total > best:
                    best, count, unknown = total, counts[start] + 1, unknowns[start]
                single = single or length == 1
                end, match = next(matches, (-1, None))
            if not single:
                total = scores[at] + self.unknown
                if best is None or total > best:
                    best, count, unknown = total, counts[at] + len(text[at].encode()), unknowns[at] + 1
            scores.append(best)
            counts.append(count)
            unknowns.append(unknown)
        return counts[-1], scores[-1], unknowns[-1]

    def count(self, text: str | None) -> tuple[int, float, int]:
        if not text:
            return 0, 0.0, 0
        text = text.replace(MARK, " ")
        count, score, unknown = 0, 0.0, 0
        known = self.known
        for part in text[text[0] == " " :].split(" "):
            own = known.get(part)
            if own is None:
                own = self.part(MARK + part)
                if len(part) <= LONGEST_MEMO:
                    if len(known) >= self.bound:
                        known.clear()
                    known[part] = own
            count += own[0]
            score += own[1]
            unknown += own[2]
        return count, score, unknown


@functools.lru_cache(maxsize=2)
def load_counter(path: str) -> UnigramCounter:
    """The counter of a vocabulary file, made once per Python worker."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    worst = min(model.get_score(i) for i in range(len(model)))
    return UnigramCounter(pieces, worst)


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df[keep]`` with n_pieces, best_score and n_unknown of each text."""

    def make():
        counter = load_counter(path)

        def work(column):
            rows = [counter.count(t) for t in column.to_pylist()]
            return list(zip(*rows, strict=True)) if rows else [[], [], []]

        return work

    return add_columns(df, [text], COUNTED, make, keep)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    documents = documents.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return count_tokens(documents, vocabulary_path("piece_bpe_32k.model"), keep=["doc_id", "n_chars"])
