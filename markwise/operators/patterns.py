"""Keyword patterns: candidates, support, de-duplication and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import text
from markwise.operators.skew import salted_join

KEYS = ["lesson", "exp_num"]
GROUP = [*KEYS, "label"]


def sentence_words(tokens: Column) -> Column:
    """Distinct words of a sentence, with one mark if it negates."""
    words = F.array_distinct(tokens)
    negated = text.negation_count(tokens) > 0
    return F.when(negated, F.array_union(words, F.array(F.lit(fixed.NEGATION_MARK)))).otherwise(words)


def candidate_patterns(representatives: DataFrame) -> DataFrame:
    """(lesson, exp_num, label, pattern) from (…, tokens) representatives.

    Single words and sorted pairs of words of one representative, negation
    words standing as one mark. A representative has fewer than 20 words.
    """
    marked = F.transform(
        "tokens",
        lambda w: F.when(text.negation_count(F.array(w)) > 0, fixed.NEGATION_MARK).otherwise(w),
    )
    words = representatives.select(*GROUP, F.array_sort(F.array_distinct(marked)).alias("words"))
    pairs = F.flatten(
        F.transform(
            "words",
            lambda a: F.transform(
                F.filter("words", lambda b: b > a), lambda b: F.concat(a, F.lit(" + "), b)
            ),
        )
    )
    return words.select(*GROUP, F.explode(F.concat("words", pairs)).alias("pattern")).filter(
        F.col("pattern") != ""
    ).distinct()


def pattern_support(patterns: DataFrame, sentences: DataFrame) -> DataFrame:
    """(lesson, exp_num, label, pattern, hits_good, hits_bad) over all sentences.

    ``sentences``: (lesson, exp_num, sentence, y, tokens). The sentence words
    are first cut down to words that occur in some pattern of the expectation;
    what is left per sentence is joined to the patterns by their first word.
    """
    parsed = patterns.withColumn("words", text.pattern_words(F.col("pattern")))
    wanted = parsed.select(*KEYS, F.explode("words").alias("word")).distinct()
    words = sentences.select(*KEYS, "sentence", "y", F.explode(sentence_words(F.col("tokens"))).alias("word"))
    kept = salted_join(words, wanted, [*KEYS, "word"], "sentence", "left_semi")
    sets = kept.groupBy(*KEYS, "sentence", "y").agg(F.collect_set("word").alias("found"))
    keyed = parsed.select(*GROUP, "pattern", F.col("words")[0].alias("word"), "words")
    hits = salted_join(
        sets.select(*KEYS, "sentence", "y", "found", F.explode("found").alias("word")),
        keyed,
        [*KEYS, "word"],
        "sentence",
        "inner",
    ).filter(F.forall("words", lambda w: F.array_contains("found", w)))
    counted = hits.groupBy(*GROUP, "pattern").agg(
        F.sum("y").alias("hits_good"), F.sum(1 - F.col("y")).alias("hits_bad")
    )
    zero = F.lit(0)
    return patterns.join(counted, [*GROUP, "pattern"], "left").select(
        *GROUP,
        "pattern",
        F.coalesce("hits_good", zero).cast("bigint").alias("hits_good"),
        F.coalesce("hits_bad", zero).cast("bigint").alias("hits_bad"),
    )


def pattern_scores(support: DataFrame, class_sizes: DataFrame) -> DataFrame:
    """Adds score: 1 - hits in the pattern's own class / size of the other class."""
    other = F.when(F.col("label") == fixed.GOOD, F.col("n_bad")).otherwise(F.col("n_good"))
    own = F.when(F.col("label") == fixed.GOOD, F.col("hits_good")).otherwise(F.col("hits_bad"))
    return support.join(class_sizes, KEYS).withColumn(
        "score", F.when(other > 0, 1 - own / F.nullif(other, F.lit(0)))
    )


def deduplicate(
    scored: DataFrame, cutoff: float = fixed.PATTERN_CUTOFF, top: int = fixed.PATTERN_TOP_N
) -> DataFrame:
    """The ``top`` lowest scores above ``cutoff``, less the patterns one of whose
    words already passed, earlier in the alphabet, with a score as high."""
    passed = scored.filter(F.col("score") > cutoff)
    words = passed.select(*GROUP, "pattern", "score", F.explode(text.pattern_words(F.col("pattern"))).alias("word"))
    singles = passed.select(*GROUP, F.col("pattern").alias("word"), F.col("score").alias("word_score"))
    beaten = (
        words.join(singles, [*GROUP, "word"])
        .filter((F.col("word") < F.col("pattern")) & (F.col("word_score") >= F.col("score")))
        .select(*GROUP, "pattern")
        .distinct()
    )
    kept = passed.join(beaten, [*GROUP, "pattern"], "left_anti")
    rank = Window.partitionBy(*GROUP).orderBy("score", "pattern")
    return kept.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= top).drop("_n")


def select_best(patterns: DataFrame, n: int = fixed.PATTERN_SELECT_N) -> DataFrame:
    """The ``n`` best patterns per group by chi-squared against the classes.

    Groups of at most ``n`` are left alone. Needs hits_good, hits_bad, n_good,
    n_bad. Of equal statistics the later pattern wins; one without any hit has
    no statistic and comes last. At most 20 patterns reach this step.
    """
    hits = F.col("hits_good") + F.col("hits_bad")
    share = F.col("n_good") / (F.col("n_good") + F.col("n_bad"))
    good, bad = hits * share, hits * (1 - share)
    statistic = F.when(
        hits > 0,
        F.try_divide((F.col("hits_good") - good) * (F.col("hits_good") - good), good)
        + F.try_divide((F.col("hits_bad") - bad) * (F.col("hits_bad") - bad), bad),
    )
    rank = Window.partitionBy(*GROUP).orderBy(F.desc_nulls_last("chi2"), F.desc("pattern"))
    size = Window.partitionBy(*GROUP)
    return (
        patterns.withColumn("chi2", statistic)
        .withColumn("_n", F.row_number().over(rank))
        .withColumn("_size", F.count(F.lit(1)).over(size))
        .filter((F.col("_n") <= n) | (F.col("_size") <= n))
        .drop("_n", "_size")
    )


def pattern_lists(selected: DataFrame) -> DataFrame:
    """(lesson, exp_num, patterns_good, patterns_bad), each in alphabetical order."""
    def of(label: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("label") == label, F.col("pattern"))))

    return selected.groupBy(*KEYS).agg(of(fixed.GOOD).alias("patterns_good"), of(fixed.BAD).alias("patterns_bad"))
