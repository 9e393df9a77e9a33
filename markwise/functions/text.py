"""Text normalisation and text features as column expressions (no UDFs).

Word characters are written out as Unicode letters, digits and underscore, so
that accented letters count as parts of words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions.numbers import words_to_digits_sql

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NEGATION = rf"(?<!{WORD})(?:{'|'.join(fixed.NEGATION_WORDS)})(?!{WORD})"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalise_label(label: Column) -> Column:
    # lowered last: Catalyst would lower labels that are literals in the driver, where
    # the first use of lower fills the heap with tables of all letters
    return F.lower(strip(label))


def normalise_answer(text: Column) -> Column:
    return strip(F.lower(text))


# The longer expressions are SQL text on a column name: one call to the JVM
# builds them, and long word lists become a hash-set lookup (IN).


def punctuation_sql(text: str) -> str:
    text = f'regexp_replace({text}, r"[\\-=]", " ")'
    text = f'replace(replace({text}, "%", " percent "), "n\'t", " not")'
    return f'regexp_replace({text}, r"[()~!^,?.\'$]", "")'


def tokens_sql(text: str) -> str:
    return f'filter(split({text}, r"{SPACE}+"), w -> w <> "")'


def content_words_sql(tokens: str) -> str:
    words = ", ".join(f'"{word}"' for word in fixed.STOP_WORDS)
    return f"filter({tokens}, w -> w NOT IN ({words}))"


def mapped_words_sql(tokens: str, mapping: dict[str, str] = fixed.WORD_MAP) -> str:
    cases = " ".join(f'WHEN w = "{word}" THEN "{other}"' for word, other in mapping.items())
    return f"transform({tokens}, w -> CASE {cases} ELSE w END)" if cases else tokens


def normalise_punctuation(column: str) -> Column:
    return F.expr(punctuation_sql(column))


def words_to_digits(column: str) -> Column:
    return F.expr(words_to_digits_sql(column))


def tokenise(column: str) -> Column:
    return F.expr(tokens_sql(column))


def drop_stop_words(column: str) -> Column:
    return F.expr(content_words_sql(column))


def map_words(column: str, mapping: dict[str, str] = fixed.WORD_MAP) -> Column:
    return F.expr(mapped_words_sql(column, mapping))


def preprocess(column: str) -> Column:
    """Raw answer text to the token array all features are computed on."""
    clean = words_to_digits_sql("t")
    words = mapped_words_sql(content_words_sql(tokens_sql(clean)))
    return F.expr(f"element_at(transform(array({punctuation_sql(f'lower({column})')}), t -> {words}), 1)")


def negation_count(tokens: Column) -> Column:
    joined = F.regexp_replace(F.concat_ws(" ", tokens), "[.*']", "")
    return F.regexp_count(joined, F.lit(NEGATION))


def negation_is_even(tokens: Column) -> Column:
    return (negation_count(tokens) % 2 == 0).cast("int")


def _unicode(pattern: Column) -> Column:
    return F.concat(F.lit("(?U)"), pattern)


def regex_hits(text: Column, patterns: Column) -> Column:
    """One 0/1 per pattern of a per-row pattern array."""
    return F.transform(patterns, lambda p: F.regexp_like(text, _unicode(p)).cast("int"))


def regex_hit_ratio(text: Column, patterns: Column) -> Column:
    hits = F.filter(patterns, lambda p: F.regexp_like(text, _unicode(p)))
    return F.when(F.size(patterns) > 0, F.size(hits) / F.size(patterns)).otherwise(F.lit(0.0))


def pattern_words(pattern: Column) -> Column:
    return F.transform(F.split(pattern, r"\+"), strip)


def pattern_match(tokens: Column, pattern: Column) -> Column:
    """1 where every keyword of ``a + [NEG] + b`` is met by the tokens."""
    negated = negation_count(tokens) > 0
    met = F.forall(
        pattern_words(pattern),
        lambda w: F.when(w == fixed.NEGATION_MARK, negated).otherwise(F.array_contains(tokens, w)),
    )
    return met.cast("int")


def length_ratio(tokens: Column, ideal: Column) -> Column:
    return F.when(F.size(ideal) > 0, F.size(tokens) / F.size(ideal)).otherwise(F.lit(0.0))


def speech_act(text: Column, pattern: str) -> Column:
    hit = F.coalesce(text, F.lit("")).rlike(f"(?iuU){pattern}")
    return F.struct(
        F.when(hit, fixed.EVALUATION_GOOD).otherwise(fixed.EVALUATION_BAD).alias("evaluation"),
        F.when(hit, 1.0).otherwise(0.0).alias("score"),
    )


def metacognitive(text: Column) -> Column:
    return speech_act(text, fixed.METACOGNITIVE)


def profanity(text: Column) -> Column:
    return speech_act(text, fixed.PROFANITY)
