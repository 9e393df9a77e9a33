"""Quality by weak supervision: rules vote or abstain, EM weighs the rules.

Every rule looks at one statistic of the whole text and votes bad or good, or
abstains where the text is too short for it. The votes of a text form a
pattern; only the counts of the patterns (at most 3 ** rules of them, whatever
the number of documents) reach the driver, where expectation-maximisation
estimates each rule's accuracies without labels. The posterior
of a pattern is the quality probability of all texts that show it. Nothing in
the estimate depends on the number of texts: a rule that no other supports
loses its weight on a large table as on a small one.

Null, empty or blank text: no words, all rules abstain, the posterior is the
one of the all-abstaining pattern. Very long texts are read whole, in memory that is
linear in their words. A column of the table named like a result gives way to
it. Repeated rows each get the same result; the
order of rows has no influence. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, table, texts_of
from markwise.session import written

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
SYMBOL_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]*[#*$%&|<>][^ \t\n\r\x0b\x0c]*")
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Words from which windows are compared as numbers instead of tuples.
MANY_WORDS = 20_000
#: Least rates of bad votes on a bad text, of the rule it is named after and of each other rule.
OWN, OTHERS = 0.5, 0.1


@dataclass(frozen=True)
class Rule:
    """Votes bad above ``bad_over``, good up to ``good_to``, else abstains;
    abstains also where the text has fewer than ``least`` of ``units``."""

    name: str
    ratio: str
    units: str
    least: int
    good_to: float
    bad_over: float


RULES = (
    Rule("symbols", "n_symbols / word_chars", "n_words", 5, 0.002, 0.03),
    Rule("marked words", "n_symbol_words / n_words", "n_words", 5, 0.03, 0.1),
    Rule("shouting", "n_upper_words / n_words", "n_words", 8, 0.05, 0.15),
    Rule("exclamations", "n_exclamations / n_words", "n_words", 8, 0.05, 0.2),
    Rule("repeated windows", "n_repeat_words / n_words", "n_words", 12, 0.05, 0.5),
    Rule("stuttering", "n_stutters / n_words", "n_words", 12, 0.03, 0.1),
    Rule("repeated lines", "n_dup_lines / n_lines", "n_lines", 4, 0.1, 0.4),
    Rule("few different words", "1 - n_distinct / n_words", "n_words", 30, 0.5, 0.7),
)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_symbol_words", "n_lines", "n_upper_words", "n_exclamations", "n_stutters", "n_distinct"]
STATISTICS = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS + MORE])


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(words) < MANY_WORDS:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes = ids
    for shift in (1, 2):
        _, codes = np.unique(codes[:-1] * len(number) + ids[shift:], return_inverse=True)
    again = np.bincount(codes)[codes] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(codes)] |= again
    return int(inside.sum())


def statistics_of(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    solid = text.translate(None, SPACES)
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    return (
        len(words),
        len(solid.decode("utf-8", "replace")),
        n_symbols,
        len(lines) - len(set(lines)),
        repeat_words(words),
        sum(1 for _ in SYMBOL_WORD.finditer(text)) if n_symbols else 0,
        len(lines),
        sum(map(bytes.isupper, words)),
        text.count(b"!"),
        sum(map(bytes.__eq__, words, words[1:])),
        len(set(words)),
    )


def text_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df[keep]`` with the statistics all rules are defined on."""

    def make():
        def work(column):
            rows = [statistics_of(t) for t in texts_of(column)]
            return list(zip(*rows, strict=True)) if rows else [[] for _ in STATISTICS]

        return work

    return add_columns(df, [text], STATISTICS, make, keep)


def vote_pattern(rules: tuple[Rule, ...] = RULES):
    """The votes as one number in base 3, a digit for each rule."""
    total = F.lit(0)
    for place, rule in enumerate(rules):
        ratio = F.expr(rule.ratio)
        vote = (
            F.when(F.expr(rule.units) < rule.least, ABSTAIN)
            .when(ratio > rule.bad_over, BAD)
            .when(ratio <= rule.good_to, GOOD)
            .otherwise(ABSTAIN)
        )
        total = total + vote * 3**place
    return total.cast("int")


def fit_votes(
    patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 500, strength: float = 4.0
) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, rates [class, rule], share of good).

    Bad texts are bad in one way or another, not in all ways at once, so the
    hidden class is 0 for good or r + 1 for bad as rule r means it; ``rates``
    are the probabilities that a vote cast on a text of the class says bad.
    Whether a rule abstains says nothing about the class. The start puts a
    text into the classes of the rules that say bad, else into good.

    Votes alone cannot tell a rule's false alarms from a kind of bad text that
    no other rule ever notices. ``OWN`` and ``OTHERS`` settle it: on a bad
    text the rule it is named after says bad in half of the votes or more, and
    every other rule in a tenth or more. So false alarms, which no other rule
    supports, leave their class round by round, and the rule counts for less.
    ``strength`` pseudo-votes keep rates of rules without votes at the beliefs.
    """
    votes = (patterns[:, None] // 3 ** np.arange(n_rules)) % 3
    bad, fine = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    weight = counts.astype(float)
    own = np.eye(n_rules, dtype=bool)
    believed = np.vstack([np.full((1, n_rules), 0.001), np.where(own, 0.9, OTHERS)])
    floor = np.vstack([np.zeros((1, n_rules)), np.where(own, OWN, OTHERS)])
    member = np.hstack([1 - bad.max(1, initial=0.0)[:, None], bad])
    member /= member.sum(1, keepdims=True)
    for _ in range(rounds):
        held = member * weight[:, None]
        said_bad = held.T @ bad + strength * believed
        rates = np.maximum(said_bad / (said_bad + held.T @ fine + strength * (1 - believed)), floor)
        share = (held.sum(0) + 1) / (held.sum() + n_rules + 1)
        log = np.log(share) + bad @ np.log(rates).T + fine @ np.log1p(-rates).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - member).max(initial=0.0) < 1e-9
        member = new
        if done:
            break
    return member[:, 0], rates, float(share[0])


def accuracies(rates: np.ndarray) -> np.ndarray:
    """(right about its own kind of bad text, right about good ones) per rule."""
    return np.stack([np.diagonal(rates[1:]), 1 - rates[0]], 1)


def quality_rules(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``df[keep]`` with the text statistics, ``p_good`` and ``votes``.

    One pass over the texts, written once; the counts of the patterns come
    from the written table and the posteriors go back into it as a literal
    map of at most 3 ** len(rules) entries.
    """
    seen = written(text_statistics(df, text, keep).withColumn("votes", vote_pattern(rules)), "quality")
    found = seen.groupBy("votes").count().orderBy("votes").collect()
    if not found:
        return seen.withColumn("p_good", F.lit(None).cast("double"))
    patterns = np.array([r[0] for r in found], np.int64)
    good, _, _ = fit_votes(patterns, np.array([r[1] for r in found]), len(rules))
    pairs = ", ".join(f"{p}, {g!r}D" for p, g in zip(patterns.tolist(), good.tolist(), strict=True))
    return seen.withColumn("p_good", F.element_at(F.expr(f"map({pairs})"), F.col("votes")))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id",
        *COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("p_good") >= 0.5)).alias("kept"),
        F.round("p_good", 6).alias("p_good"),
    )
