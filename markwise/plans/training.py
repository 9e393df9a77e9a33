"""Training of all lessons at once: rows, generated features, models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import text
from markwise.operators import assembly, density, embedding, logistic, lookup, patterns, tournament, training_rows
from markwise.operators.skew import salted_join
from markwise.session import written

KEYS = ["lesson", "exp_num"]
GROUP = [*KEYS, "label"]
NONE = "CAST(array() AS array<string>)"


@dataclass
class TrainingOptions:
    """Job parameters; the defaults are the service's."""

    quality: int = fixed.TRAIN_QUALITY  # 0 none, 1 archetypes, 2 archetypes and patterns
    length_ratio: bool = False
    regex_vector: bool = False
    developer_mode: bool = False
    radius: float = fixed.CLUSTER_RADIUS
    local_rows: int = logistic.LOCAL_ROWS


@dataclass
class Trained:
    rows: DataFrame
    features: DataFrame
    models: DataFrame
    configs: DataFrame
    embeddings: DataFrame


def training_set(training: DataFrame, expectations: DataFrame, developer_mode: bool = False) -> DataFrame:
    """(lesson, exp_num, place, row_id, text, label) of every trained expectation.

    Expectations and the keys to keep are written first: the rows ask for them many
    times, and a plan with all of their sources in it is too large for a small driver.
    """
    expectations = written(expectations, "expectations")
    keep = written(training_rows.trainable(training, expectations, developer_mode), "keep")
    rows = training_rows.ordered_rows(training, expectations, keep)
    return training_rows.with_all_concepts(rows, expectations)


def sentences(rows: DataFrame) -> DataFrame:
    """Adds tokens, a text key and ``sentence``, a number in training order."""
    number = F.col("place") * F.lit(10**15) + F.col("row_id") + 1
    return rows.select(
        *GROUP, "place", "row_id", number.cast("bigint").alias("sentence"), "text",
        text.preprocess("text").alias("tokens"), F.sha2("text", 256).alias("text_key"),
    )


def cluster_sentences(said: DataFrame, vocabulary: DataFrame, radius: float = fixed.CLUSTER_RADIUS) -> DataFrame:
    """Adds the cluster of each sentence among those of its expectation and label."""
    distinct = said.groupBy("text_key").agg(F.first("tokens").alias("tokens"))
    means = embedding.mean_vectors(distinct, vocabulary, ["text_key"], unique=True)
    points = said.select(*GROUP, F.col("sentence").alias("id"), "text_key")
    points = salted_join(points, means, ["text_key"], [*GROUP, "id"], "inner")
    clusters = density.density_clusters(points, GROUP, radius).withColumnRenamed("id", "sentence")
    return said.join(clusters, [*GROUP, "sentence"])


def generate(said: DataFrame, vocabulary: DataFrame, options: TrainingOptions) -> DataFrame:
    """(lesson, exp_num, archetype_…, patterns_…) mined from the training answers."""
    width = embedding.vector_width(vocabulary)
    clustered = written(cluster_sentences(said, vocabulary, options.radius), "clustered")
    winners = tournament.representatives(
        clustered.select(*GROUP, "cluster", "place", F.col("sentence").alias("id"), "tokens"),
        vocabulary, [*GROUP, "cluster"], width,
    )
    winners = written(winners, "winners")
    # each part is written, so that the settings' plan does not hold them all
    generated = said.select(*KEYS).distinct().join(tournament.archetypes(winners, KEYS), KEYS, "left")
    if options.quality > 1:
        generated = generated.join(mine_patterns(winners, said), KEYS, "left")
    return generated


def mine_patterns(winners: DataFrame, said: DataFrame) -> DataFrame:
    y = training_rows.encode_label(F.col("label"))
    spoken = said.select(*KEYS, "sentence", y.alias("y"), "tokens")
    sizes = spoken.groupBy(*KEYS).agg(F.sum("y").alias("n_good"), F.sum(1 - F.col("y")).alias("n_bad"))
    candidates = written(patterns.candidate_patterns(winners), "candidates")
    scored = patterns.pattern_scores(patterns.pattern_support(candidates, spoken), sizes)
    kept = patterns.deduplicate(written(scored, "scored"))
    return written(patterns.pattern_lists(patterns.select_best(kept)), "patterns")


def train(
    training: DataFrame, expectations: DataFrame, vocabulary: DataFrame, options: TrainingOptions | None = None
) -> Trained:
    """Models, updated configs and slim embeddings of all trainable expectations.

    ``vocabulary`` should be a stored table: it is read several times.
    """
    options = options or TrainingOptions()
    expectations = written(expectations, "given")
    if not expectations.filter("coalesce(question, '') = ''").isEmpty():
        raise ValueError("every lesson config must have a question")
    rows = written(training_set(training, expectations, options.developer_mode), "training")
    said = written(sentences(rows), "said")
    known = expectations.select(*KEYS, "pos", "question", "ideal", "good", "bad")
    known = written(lookup.first_configs(known), "expectations")
    settings = known.withColumn("question_tokens", text.preprocess("question"))
    settings = settings.join(written(training_rows.reference_tokens(rows), "references"), KEYS)
    if options.quality > 0:
        settings = settings.join(generate(said, vocabulary, options), KEYS, "left")
    for name in ("archetype_good", "archetype_bad", "patterns_good", "patterns_bad"):
        present = F.col(name) if name in settings.columns else F.lit(None).cast("array<string>")
        settings = settings.withColumn(name, F.coalesce(present, F.expr(NONE)))
    settings = settings.withColumn("archetypes", F.concat("archetype_good", "archetype_bad"))
    settings = written(settings.withColumn("patterns", F.concat("patterns_good", "patterns_bad")), "settings")

    answers = said.select(*KEYS, "place", "row_id", "label", "text")
    features = assembly.assemble(answers, settings, vocabulary, options.length_ratio, options.regex_vector)
    y = training_rows.encode_label(F.col("label")).cast("int").alias("y")
    features = written(features.select(*KEYS, "place", "row_id", y, "x"), "features")
    models = logistic.fit_models(features, KEYS, options.local_rows).withColumn("arch", F.lit(fixed.ARCH_REGRESSION))
    # every expectation stays in the config; untrained ones have nothing generated
    lists = ("archetype_good", "archetype_bad", "patterns_good", "patterns_bad")
    made = settings.select(*KEYS, *lists, F.lit(True).alias("_trained"))
    trained = F.coalesce("_trained", F.lit(False))
    configs = known.join(made, KEYS, "left").select(
        *KEYS, "pos", "question", "ideal", "good", "bad",
        *[F.coalesce(name, F.expr(NONE)).alias(name) for name in lists],
        F.lit(options.length_ratio).alias(fixed.FEATURE_LENGTH_RATIO),
        F.lit(options.regex_vector).alias(fixed.FEATURE_REGEX_AGGREGATE_DISABLED),
        (trained & (options.quality >= 1)).alias(fixed.FEATURE_ARCHETYPE_ENABLED),
        (trained & (options.quality > 1)).alias(fixed.FEATURE_PATTERNS_ENABLED),
    )
    configs = written(configs, "configs")
    slim = embedding.slim_embeddings(settings, vocabulary) if "in_slim" in vocabulary.columns else None
    return Trained(rows, features, written(models, "models"), configs, slim)


def default_features(training: DataFrame, expectations: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Features of all lessons' rows pooled, raw case, no regexes, keyed by row.

    Words count as known only where the slim vocabulary has them; a row keeps
    its own lesson's question and ideal.
    """
    rows = training.filter(F.col("label").isin(fixed.GOOD, fixed.BAD) & F.col("text").isNotNull()).select(
        *KEYS, F.lit(1).alias("place"), "row_id", "label", "text"
    )
    settings = expectations.select(
        *KEYS,
        text.preprocess("ideal").alias("ideal_tokens"),
        text.preprocess("question").alias("question_tokens"),
        *[F.expr(NONE).alias(name) for name in ("good", "bad", "archetypes", "patterns")],
    )
    slim = vocabulary.filter("in_slim")
    features = assembly.assemble(rows, settings, slim)
    y = training_rows.encode_label(F.col("label")).cast("int").alias("y")
    return features.select(*KEYS, "place", "row_id", y, "x")


def train_default(
    training: DataFrame, expectations: DataFrame, vocabulary: DataFrame, local_rows: int = logistic.LOCAL_ROWS
) -> DataFrame:
    """The pooled default model: (arch, lesson='default', exp_num, …)."""
    features = default_features(training, expectations, vocabulary)
    number = F.xxhash64("lesson", "exp_num", "row_id")
    pooled = written(
        features.select(F.lit(fixed.DEFAULT_LESSON).alias("lesson"), F.lit("").alias("exp_num"),
                        "place", number.alias("row_id"), "y", "x"), "pooled")
    return logistic.fit_models(pooled, KEYS, local_rows).withColumn("arch", F.lit(fixed.ARCH_REGRESSION))
