"""Feature vectors of answers against their expectation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.functions import text, vectors
from markwise.functions.numbers import words_to_digits_sql
from markwise.operators.alignment import aligned_means
from markwise.operators.embedding import archetype_similarities, mean_vectors, vector_width
from markwise.operators.skew import salted_join
from markwise.session import written

KEYS = ["lesson", "exp_num"]
NO_STRINGS = "CAST(array() AS array<string>)"
NO_VECTORS = "CAST(array() AS array<array<double>>)"


def own_features(length_ratio: Column, regex_vector: Column) -> list[Column]:
    """What a row's text and its settings tell by themselves: negations, length_ratios, regexes, pattern_hits.

    Expects tokens, negated (their negations), ideal_tokens, digits (raw text, number words as
    digits), good, bad and patterns; flags may be literals or config columns.
    """
    negations = F.array(F.col("negated").cast("double"), (F.col("negated") % 2 == 0).cast("int").cast("double"))
    none = F.expr("CAST(array() AS array<double>)")
    ratio = F.when(length_ratio, F.array(text.length_ratio(F.col("tokens"), F.col("ideal_tokens")))).otherwise(none)
    hits = F.concat(
        text.regex_hits(F.col("digits"), F.col("good")), text.regex_hits(F.col("digits"), F.col("bad"))
    ).cast("array<double>")
    ratios = F.array(
        text.regex_hit_ratio(F.col("digits"), F.col("good")), text.regex_hit_ratio(F.col("digits"), F.col("bad"))
    )
    regexes = F.when(regex_vector, hits).otherwise(ratios)
    patterns = F.transform("patterns", lambda p: _pattern_hit(p, F.col("negated") > 0)).cast("array<double>")
    return [
        negations.alias("negations"), ratio.alias("length_ratios"), regexes.alias("regexes"), patterns.alias("pattern_hits")
    ]


def feature_vector() -> Column:
    """The features in model order, from ``own_features`` and the columns alignment,
    ideal_similarity, question_similarity and archetype_similarities. The width
    follows the expectation, so it is an array and never a pivot."""
    return F.concat(
        "negations", F.array("alignment", "ideal_similarity", "question_similarity"),
        "length_ratios", "regexes", "archetype_similarities", "pattern_hits",
    )


def reference_vectors(expectations: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lesson, exp_num, ideal_vector, question_vector, archetype_vectors).

    Ideals, questions and archetypes of all expectations are one relation of
    short texts, so their mean vectors are one aggregation.
    """
    texts = expectations.select(
        *KEYS,
        F.posexplode(
            F.concat(
                F.array("ideal_tokens", "question_tokens"),
                F.transform("archetypes", lambda a: F.split(a, " ")),
            )
        ).alias("slot", "tokens"),
    )
    means = mean_vectors(texts, vocabulary, [*KEYS, "slot"])
    packed = means.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("slot", "vector"))).alias("v"))
    return packed.select(
        *KEYS,
        F.col("v")[0]["vector"].alias("ideal_vector"),
        F.col("v")[1]["vector"].alias("question_vector"),
        F.slice(F.col("v.vector"), F.lit(3), F.greatest(F.size("v") - 2, F.lit(0))).alias("archetype_vectors"),
    )


def assemble(
    answers: DataFrame,
    expectations: DataFrame,
    vocabulary: DataFrame,
    length_ratio: Column | bool = False,
    regex_vector: Column | bool = False,
) -> DataFrame:
    """(answer columns…, x) for (row_key, lesson, exp_num, text, …) rows.

    ``expectations``: (lesson, exp_num, ideal_tokens, question_tokens, good,
    bad, archetypes, patterns, plus any flag columns). A text is compared with
    an expectation once, whatever the number of its copies. ``vocabulary``
    should be a stored table: it is read twice.
    """
    expectations = written(expectations, "expectations")
    flags = [c for c in expectations.columns if c.startswith("feature")]
    settings = expectations.select(*KEYS, "ideal_tokens", "good", "bad", "patterns", *flags)
    rows = answers.withColumn("text_key", F.sha2("text", 256)).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "answers")

    texts = rows.groupBy("text_key").agg(F.first("text").alias("text"), F.collect_set(F.struct(*KEYS)).alias("_asked"))
    texts = texts.filter("text_key IS NOT NULL").withColumn("tokens", text.preprocess("text"))
    # negations are counted once a text, not for every expectation and pattern
    texts = texts.withColumn("negated", text.negation_count(F.col("tokens")))
    pairs = texts.withColumn("digits", F.expr(words_to_digits_sql("text"))).select(
        "text_key", "tokens", "digits", "negated", F.inline("_asked"))
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    own = own_features(as_column(length_ratio), as_column(regex_vector))
    pairs = salted_join(pairs, settings, KEYS, "text_key", "inner").select("text_key", *KEYS, "tokens", "ideal_tokens", *own)
    compared = aligned_means(pairs, vocabulary, vector_width(vocabulary))
    references = written(reference_vectors(expectations, vocabulary), "references")
    per_pair = salted_join(compared, references, KEYS, "text_key", "inner").withColumns({
        "ideal_similarity": vectors.cosine(F.col("vector"), F.col("ideal_vector")),
        "question_similarity": vectors.cosine(F.col("vector"), F.col("question_vector")),
        "archetype_similarities": archetype_similarities(F.col("vector"), F.col("archetype_vectors")),
    })
    per_pair = written(per_pair.select("text_key", *KEYS, feature_vector().alias("x")), "features")
    # copies of one text share a pair, so the join spreads by row
    joined = salted_join(rows, per_pair, ["text_key", *KEYS], "_row", "inner")
    return joined.select(*answers.columns, "x")


def _pattern_hit(pattern: Column, negated: Column) -> Column:
    met = F.forall(
        text.pattern_words(pattern),
        lambda w: F.when(w == text.fixed.NEGATION_MARK, negated).otherwise(F.array_contains(F.col("tokens"), w)),
    )
    return met.cast("int")
