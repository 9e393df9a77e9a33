"""Queries of training: rows, vectors, features, models, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import text, vectors
from markwise.operators import assembly, embedding, evaluation, ledger, logistic, lookup, scoring, training_rows
from markwise.operators.alignment import alignment_certificates, checked_certificates, leftover_words, word_alignment
from markwise.plans import bindings as b
from markwise.plans import oracle as o
from markwise.plans import training as t
from markwise.plans.catalog_joins import COUNTED, counted_models
from markwise.plans.evaluate import evaluate
from markwise.plans.registry import query
from markwise.session import written

KEYS = ["lesson", "exp_num"]
TRAIN = o.with_(o.RAW, o.EXPECT, o.CLEAN, o.KEEP, o.ROWS, o.WHOLE)
TOKENS = f"said AS (SELECT *, {o.tokens('text')} AS tokens FROM train)"


def inputs(spark, sf_dir):
    return b.raw_training(spark, sf_dir), b.expectations(spark, sf_dir)


def stored_vocabulary(spark, sf_dir):
    return written(b.vocabulary(spark, sf_dir), "vocabulary")


def vector_columns(vector):
    """A vector in three numbers: sum, length and first component."""
    total = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v)
    return [F.round(total, 6).alias("total"), F.round(vectors.norm(F.col(vector)), 6).alias("norm"),
            F.round(F.col(vector)[0], 6).alias("first")]


_VECTOR = "round(list_sum(vector), 6) AS total, round(sqrt(list_dot_product(vector, vector)), 6) AS norm, round(vector[1], 6) AS first"


@query("mean_word_vectors", o.with_(o.VOCAB, f"docs AS (SELECT doc_id, {o.tokens('text')} AS tokens FROM documents)",
                                    o.means("docs", "doc_id", "tokens", "mean")) + f"SELECT doc_id, n_known, {_VECTOR} FROM mean")
def mean_word_vectors(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").select("doc_id", text.preprocess("text").alias("tokens"))
    means = embedding.mean_vectors(docs, stored_vocabulary(spark, sf_dir), ["doc_id"])
    return means.select("doc_id", "n_known", *vector_columns("vector"))


@query("cosine_similarity", "WITH c AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
       "d AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM c) GROUP BY ALL), "
       "g AS (SELECT label, list(m ORDER BY i) AS m FROM d GROUP BY label) "
       f"SELECT vec_id, round({o.cosine('v', 'm')}, 6) AS similarity FROM c JOIN g USING (label)")
def cosine_similarity(spark, sf_dir):
    rows = b.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    width = embedding.vector_width(rows.select(F.col("v").alias("vector")))
    sums = rows.groupBy("label").agg(*[F.expr(f"avg(v[{i}]) AS m{i}") for i in range(width)])
    centres = sums.select("label", F.expr(f"array({', '.join(f'm{i}' for i in range(width))})").alias("m"))
    return rows.join(centres, "label").select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("m")), 6).alias("similarity"))


_PAIRS = (
    f"rt AS (SELECT lesson, exp_num, row_id, {o.tokens('text')} AS tokens FROM raw), "
    f"et AS (SELECT *, {o.tokens('ideal')} AS it, {o.tokens('question')} AS qt FROM expect)"
)


def _similarity_sql(reference: str) -> str:
    return (
        o.with_(o.RAW, o.EXPECT, o.VOCAB, _PAIRS,
                "rd AS (SELECT row_id, any_value(tokens) AS tokens FROM rt GROUP BY row_id)",
                o.means("rd", "row_id", "tokens", "am"), o.means("et", "lesson, exp_num", reference, "em"))
        + f"SELECT rt.lesson, rt.exp_num, rt.row_id, round({o.cosine('am.vector', 'em.vector')}, 6) AS similarity "
        "FROM rt JOIN am USING (row_id) JOIN em USING (lesson, exp_num)"
    )


def _reference_similarity(spark, sf_dir, column):
    training, expectations = inputs(spark, sf_dir)
    vocabulary = stored_vocabulary(spark, sf_dir)
    docs = training.select("row_id", "text").dropDuplicates(["row_id"]).select("row_id", text.preprocess("text").alias("tokens"))
    answers = embedding.mean_vectors(docs, vocabulary, ["row_id"]).select("row_id", F.col("vector").alias("a"))
    references = written(expectations.select(*KEYS, text.preprocess(column).alias("tokens")), "references")
    means = embedding.mean_vectors(references, vocabulary, KEYS).select(*KEYS, F.col("vector").alias("e"))
    rows = training.select(*KEYS, "row_id").join(answers, "row_id")
    return lookup.salted_join(rows, means, KEYS, "row_id", "inner").select(
        *KEYS, "row_id", F.round(vectors.cosine(F.col("a"), F.col("e")), 6).alias("similarity"))


@query("ideal_similarity", _similarity_sql("it"))
def ideal_similarity(spark, sf_dir):
    return _reference_similarity(spark, sf_dir, "ideal")


@query("question_similarity", _similarity_sql("qt"))
def question_similarity(spark, sf_dir):
    return _reference_similarity(spark, sf_dir, "question")


@query("archetype_similarity", o.with_(o.RAW, o.EXPECT, o.VOCAB, _PAIRS,
       "ar AS (SELECT lesson, exp_num, 0 AS slot, it AS tokens FROM et UNION ALL SELECT lesson, exp_num, 1, qt FROM et)",
       "rd AS (SELECT row_id, any_value(tokens) AS tokens FROM rt GROUP BY row_id)",
       o.means("rd", "row_id", "tokens", "am"), o.means("ar", "lesson, exp_num, slot", "tokens", "em"))
       + f"SELECT rt.lesson, rt.exp_num, rt.row_id, slot, round({o.cosine('am.vector', 'em.vector')}, 6) AS similarity "
       "FROM rt JOIN am USING (row_id) JOIN em USING (lesson, exp_num)")
def archetype_similarity(spark, sf_dir):
    """Similarities to two archetypes per expectation: its ideal and its question."""
    training, expectations = inputs(spark, sf_dir)
    vocabulary = stored_vocabulary(spark, sf_dir)
    docs = training.select("row_id", "text").dropDuplicates(["row_id"]).select("row_id", text.preprocess("text").alias("tokens"))
    answers = embedding.mean_vectors(docs, vocabulary, ["row_id"]).select("row_id", F.col("vector").alias("a"))
    none = F.expr("CAST(array() AS array<string>)")
    tokens = expectations.select(*KEYS, text.preprocess("ideal").alias("i"), text.preprocess("question").alias("q"))
    settings = tokens.select(*KEYS, none.alias("ideal_tokens"), none.alias("question_tokens"),
                             F.array(F.array_join("i", " "), F.array_join("q", " ")).alias("archetypes"))
    references = assembly.reference_vectors(written(settings, "references"), vocabulary)
    rows = training.select(*KEYS, "row_id").join(answers, "row_id")
    joined = lookup.salted_join(rows, references, KEYS, "row_id", "inner")
    values = embedding.archetype_similarities(F.col("a"), F.col("archetype_vectors"))
    return joined.select(*KEYS, "row_id", F.posexplode(values).alias("slot", "s")).select(
        *KEYS, "row_id", "slot", F.round("s", 6).alias("similarity"))


@query("optimal_word_alignment")
def optimal_word_alignment(spark, sf_dir):
    """Alignment of every labelled answer, whole, with its expectation's ideal."""
    training, expectations = inputs(spark, sf_dir)
    vocabulary = stored_vocabulary(spark, sf_dir)
    rows = training.select(*KEYS, "row_id", "text").withColumn("tokens", text.preprocess("text")).drop("text")
    ideals = expectations.select(*KEYS, text.preprocess("ideal").alias("ideal_tokens"))
    width = embedding.vector_width(vocabulary)
    scores = word_alignment(written(rows, "rows"), written(ideals, "ideals"), vocabulary, "row_id", KEYS, width)
    return scores.select(*KEYS, "row_id", F.round("alignment", 6).alias("alignment"))


_SIDES = (
    "sides AS (SELECT rt.lesson, rt.exp_num, rt.row_id, list_distinct(list_filter(rt.tokens, lambda w: NOT list_contains(et.it, w))) AS l, "
    "list_distinct(list_filter(et.it, lambda w: NOT list_contains(rt.tokens, w))) AS r, len(list_distinct(et.it)) AS n FROM rt JOIN et USING (lesson, exp_num))"
)
_SINGLE = (
    "single AS (SELECT lesson, exp_num, row_id, max(" + o.cosine("a.vector", "c.vector") + ") AS best FROM "
    "(SELECT lesson, exp_num, row_id, x, unnest(r) AS y FROM (SELECT *, unnest(l) AS x FROM sides WHERE least(len(l), len(r)) = 1)) "
    "JOIN vocab a ON a.word = x JOIN vocab c ON c.word = y GROUP BY ALL)"
)


@query("alignment_certificate", o.with_(o.RAW, o.EXPECT, o.VOCAB, _PAIRS, _SIDES, _SINGLE)
       + "SELECT lesson, exp_num, row_id, len(l) AS answer_left, len(r) AS ideal_left, true AS feasible, true AS tight, "
       "round((n - len(r) + best) / n, 6) AS alignment FROM sides LEFT JOIN single USING (lesson, exp_num, row_id) WHERE len(l) > 0 AND len(r) > 0")
def alignment_certificate(spark, sf_dir):
    """Every alignment that needs an assignment is proved to be the best: Spark
    recomputes the similarities and compares pairs with prices. Where one side
    has one word left, the alignment itself is checked, too."""
    training, expectations = inputs(spark, sf_dir)
    vocabulary = stored_vocabulary(spark, sf_dir)
    rows = training.select(*KEYS, "row_id", "text").withColumn("tokens", text.preprocess("text")).drop("text")
    rows, ideals = written(rows, "rows"), written(expectations.select(*KEYS, text.preprocess("ideal").alias("ideal_tokens")), "ideals")
    width = embedding.vector_width(vocabulary)
    found = written(alignment_certificates(rows, ideals, vocabulary, "row_id", KEYS, width), "certificates")
    checked = checked_certificates(found, ideals, vocabulary, "row_id", KEYS)
    left = leftover_words(found).select(
        *KEYS, "row_id", F.size("answer_left").cast("bigint").alias("answer_left"),
        F.size("ideal_left").cast("bigint").alias("ideal_left"), "n_ideal")
    alignment = (F.col("n_ideal") - F.col("ideal_left") + F.col("primal")) / F.col("n_ideal")
    return left.join(checked, [*KEYS, "row_id"]).select(
        *KEYS, "row_id", "answer_left", "ideal_left", "feasible",
        (F.abs(F.col("primal") - F.col("dual")) < 1e-6 * F.greatest("ideal_left", "answer_left")).alias("tight"),
        F.when(F.least("answer_left", "ideal_left") == 1, F.round(alignment, 6)).alias("alignment"))


@query("minimum_support", o.with_(o.RAW, o.EXPECT) + "SELECT e.lesson, e.exp_num, count(*) AS n_rows FROM expect e "
       "JOIN (SELECT lesson, exp_num FROM raw) USING (lesson, exp_num) GROUP BY ALL HAVING count(*) >= 10")
def minimum_support(spark, sf_dir):
    """Which expectations have ten graded rows."""
    training, expectations = inputs(spark, sf_dir)
    keep = training_rows.trainable(training, expectations)
    return training.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")).join(keep, KEYS, "left_semi")


@query("training_set_order", TRAIN + "SELECT lesson, exp_num, place, row_id, label, md5(text) AS text FROM train WHERE place < 2")
def training_set_order(spark, sf_dir):
    training, expectations = inputs(spark, sf_dir)
    rows = training_rows.ordered_rows(training, expectations, training_rows.trainable(training, expectations))
    return rows.select(*KEYS, "place", "row_id", "label", F.md5("text").alias("text"))


@query("all_concepts_answer", TRAIN + "SELECT lesson, exp_num, md5(text) AS text FROM train WHERE place = 2")
def all_concepts_answer(spark, sf_dir):
    rows = t.training_set(*inputs(spark, sf_dir))
    return rows.filter("place = 2").select(*KEYS, F.md5("text").alias("text"))


@query("label_encoding", TRAIN + "SELECT lesson, exp_num, place, row_id, CASE label WHEN 'good' THEN 1 ELSE 0 END AS y FROM train")
def label_encoding(spark, sf_dir):
    rows = t.training_set(*inputs(spark, sf_dir))
    return rows.select(*KEYS, "place", "row_id", training_rows.encode_label(F.col("label")).alias("y"))


@query("reference_tokens", TRAIN + f"SELECT lesson, exp_num, {o.joined('tokens')} AS tokens, len(tokens) AS n FROM (SELECT lesson, exp_num, "
       f"{o.tokens('text')} AS tokens, row_number() OVER (PARTITION BY lesson, exp_num ORDER BY place, row_id) AS k FROM train) WHERE k = 1")
def reference_tokens(spark, sf_dir):
    found = training_rows.reference_tokens(t.training_set(*inputs(spark, sf_dir)))
    return found.select(*KEYS, F.md5(F.array_join("ideal_tokens", " ")).alias("tokens"), F.size("ideal_tokens").cast("bigint").alias("n"))


def _assembled(spark, sf_dir, length_ratio=False, regex_vector=False):
    training, expectations = inputs(spark, sf_dir)
    rows = written(t.training_set(training, expectations), "training")
    none = F.expr("CAST(array() AS array<string>)")
    settings = expectations.select(*KEYS, "good", "bad", text.preprocess("question").alias("question_tokens"),
                                   none.alias("archetypes"), none.alias("patterns"))
    settings = settings.join(training_rows.reference_tokens(rows), KEYS)
    return assembly.assemble(rows, settings, stored_vocabulary(spark, sf_dir), length_ratio, regex_vector)


def _features_sql(tail: str) -> str:
    """Rows (lesson, exp_num, place, row_id, slot, value) of all but the alignment."""
    ctes = o.with_(
        o.RAW, o.EXPECT, o.CLEAN, o.KEEP, o.ROWS, o.WHOLE, o.VOCAB,
        f"said AS (SELECT *, {o.tokens('text')} AS tokens, md5(text) AS tk FROM train)",
        "firsts AS (SELECT lesson, exp_num, arg_min(tokens, place * 1000000000000 + row_id) AS it FROM said GROUP BY ALL)",
        f"et AS (SELECT lesson, exp_num, it, {o.tokens('question')} AS qt, good, bad FROM expect JOIN firsts USING (lesson, exp_num))",
        "rd AS (SELECT tk, any_value(tokens) AS tokens FROM said GROUP BY tk)",
        o.means("rd", "tk", "tokens", "am"), o.means("et", "lesson, exp_num", "it", "im"), o.means("et", "lesson, exp_num", "qt", "qm"),
        f"wide AS (SELECT s.*, et.*, {o.negations('tokens')} AS neg, {o.cosine('am.vector', 'im.vector')} AS si, {o.cosine('am.vector', 'qm.vector')} AS sq "
        "FROM (SELECT lesson AS l, exp_num AS x, place, row_id, text, tokens, tk FROM said) s JOIN et ON l = et.lesson AND x = et.exp_num "
        "JOIN am USING (tk) JOIN im ON l = im.lesson AND x = im.exp_num JOIN qm ON l = qm.lesson AND x = qm.exp_num)",
    )
    return ctes + tail


_BASE = "CAST(neg AS DOUBLE), CASE WHEN neg % 2 = 0 THEN 1.0 ELSE 0.0 END, NULL, si, sq"


def _slots(values: str) -> str:
    return _features_sql(f"SELECT lesson, exp_num, place, row_id, slot, round(v[slot + 1], 6) AS value FROM "
                         f"(SELECT *, unnest(range(0, len(v))) AS slot FROM (SELECT lesson, exp_num, place, row_id, {values} AS v FROM wide)) WHERE slot <> 2")


def _exploded(features):
    slots = features.select(*KEYS, "place", "row_id", F.posexplode("x").alias("slot", "value")).filter("slot <> 2")
    return slots.withColumn("slot", F.col("slot").cast("bigint")).withColumn("value", F.round("value", 6))


@query("feature_assembly", _slots(f"[{_BASE}, {o.ratio('text', 'good')}, {o.ratio('text', 'bad')}]"))
def feature_assembly(spark, sf_dir):
    """The seven features of train quality 0; the alignment is checked apart."""
    return _exploded(_assembled(spark, sf_dir))


@query("feature_assembly_flags", _slots(
    f"list_concat([{_BASE}, CASE WHEN len(it) > 0 THEN len(tokens) / len(it) ELSE 0 END], CAST(list_concat({o.hits('text', 'good')}, {o.hits('text', 'bad')}) AS DOUBLE[]))"))
def feature_assembly_flags(spark, sf_dir):
    """With the length ratio, and one 0/1 per regex instead of the two ratios."""
    return _exploded(_assembled(spark, sf_dir, length_ratio=True, regex_vector=True))


def _trained(spark, sf_dir, quality, given=None):
    """Training at one quality, from tables that were read before if they are given."""
    training, expectations = inputs(spark, sf_dir) if given is None else given[:2]
    vocabulary = stored_vocabulary(spark, sf_dir) if given is None else given[2]
    return t.train(training, expectations, vocabulary, t.TrainingOptions(quality=quality))


@query("model_fit_optimality", TRAIN + "SELECT lesson, exp_num, count(*) AS n_rows, true AS stationary FROM train "
       "GROUP BY ALL HAVING count(DISTINCT label) = 2")
def model_fit_optimality(spark, sf_dir):
    """Checks each fitted model against its objective: the gradient is zero.

    The gradient is summed by Spark from the feature rows and the published
    coefficients, apart from the solver.
    """
    trained = _trained(spark, sf_dir, fixed.TRAIN_QUALITY)
    classes = trained.features.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_good"))
    rows = lookup.salted_join(trained.features, trained.models.join(classes, KEYS), KEYS, "row_id", "inner")
    z = scoring.decision(F.col("x"), F.col("coef"), F.col("intercept"))
    weight = F.col("n") / (2 * F.when(F.col("y") == 1, F.col("n_good")).otherwise(F.col("n") - F.col("n_good")))
    pull = weight * (vectors.logistic(z) - F.col("y"))
    parts = rows.select(*KEYS, "n_rows", pull.alias("pull"),
                        F.posexplode(F.arrays_zip(F.concat("x", F.array(F.lit(1.0))).alias("x"),
                                                  F.concat("coef", F.array("intercept")).alias("c"))).alias("slot", "p"))
    sums = parts.groupBy(*KEYS, "n_rows", "slot").agg((F.sum(F.col("pull") * F.col("p")["x"]) + F.max(F.col("p")["c"])).alias("g"))
    return sums.groupBy(*KEYS, "n_rows").agg((F.max(F.abs("g")) < 1e-7 * F.greatest(F.lit(1), F.col("n_rows"))).alias("stationary"))


@query("leave_one_out_accuracy")
def leave_one_out_accuracy(spark, sf_dir):
    models = _trained(spark, sf_dir, fixed.TRAIN_QUALITY).models
    return models.select(*KEYS, "n_rows", F.round("accuracy", 6).alias("accuracy"))


@query("train_all_lessons")
def train_all_lessons(spark, sf_dir):
    """Training at full quality: clusters, archetypes, patterns, models."""
    trained = _trained(spark, sf_dir, fixed.TRAIN_QUALITY)
    summary = trained.models.select(*KEYS, "n_rows", F.size("coef").alias("width"), F.round("accuracy", 6).alias("accuracy"))
    generated = trained.configs.select(
        *KEYS, F.array_join("archetype_good", " | ").alias("archetypes"), F.array_join("patterns_good", " | ").alias("patterns_good"),
        F.array_join("patterns_bad", " | ").alias("patterns_bad"))
    return summary.join(generated, KEYS)


@query("train_quality_switch", TRAIN + "SELECT lesson, exp_num, q AS quality, 7 AS n_base, q >= 1 AS archetypes, q > 1 AS patterns "
       "FROM (SELECT DISTINCT lesson, exp_num FROM train), (SELECT unnest([0, 1, 2]) AS q)")
def train_quality_switch(spark, sf_dir):
    """Feature widths and stored flags at qualities 0, 1 and 2."""
    out = None
    training, expectations = inputs(spark, sf_dir)
    given = training, written(expectations, "given"), stored_vocabulary(spark, sf_dir)
    for quality in (0, 1, 2):
        trained = _trained(spark, sf_dir, quality, given)
        extra = F.size("archetype_good") + F.size("archetype_bad") + F.size("patterns_good") + F.size("patterns_bad")
        width = trained.features.groupBy(*KEYS).agg(F.max(F.size("x")).alias("w"))
        part = trained.configs.join(width, KEYS).select(
            *KEYS, F.lit(quality).alias("quality"), (F.col("w") - extra).alias("n_base"),
            F.col(fixed.FEATURE_ARCHETYPE_ENABLED).alias("archetypes"), F.col(fixed.FEATURE_PATTERNS_ENABLED).alias("patterns"))
        out = part if out is None else out.unionByName(part)
    return out


@query("replication_experiment", TRAIN + "SELECT lesson, exp_num, factor, max(factor) * count(*) AS n_rows, true AS loss_falls, true AS confidence_rises "
       "FROM train, (SELECT unnest([1, 2, 4, 8]) AS factor) GROUP BY ALL HAVING count(DISTINCT label) = 2")
def replication_experiment(spark, sf_dir):
    """Training on every row 1, 2, 4 and 8 times: loss and confidence by factor."""
    features = _trained(spark, sf_dir, fixed.TRAIN_QUALITY).features
    found = written(evaluation.replication_experiment(features, KEYS, [1, 2, 4, 8]), "replication")
    before = found.select(*KEYS, (F.col("factor") * 2).alias("factor"), F.col("loss").alias("loss_before"), F.col("confidence").alias("confidence_before"))
    both = found.join(before, [*KEYS, "factor"], "left")
    return both.select(
        *KEYS, "factor", "n_rows",
        F.coalesce(F.col("loss") <= F.col("loss_before") + 1e-9, F.lit(True)).alias("loss_falls"),
        F.coalesce(F.col("confidence") >= F.col("confidence_before") - 1e-9, F.lit(True)).alias("confidence_rises"))


@query("k_fold_accuracy")
def k_fold_accuracy(spark, sf_dir):
    """Accuracy over ten seeded folds, next to that of leaving out one row."""
    trained = _trained(spark, sf_dir, fixed.TRAIN_QUALITY)
    found = logistic.k_fold_hits(trained.features, KEYS, 10)
    rows = trained.models.select(*KEYS, F.round("accuracy", 6).alias("leave_one_out")).join(found, KEYS)
    return rows.select(*KEYS, "n_rows", F.round(F.col("hits") / F.col("n_rows"), 6).alias("accuracy"), "leave_one_out")


@query("default_model_training")
def default_model_training(spark, sf_dir):
    training, expectations = inputs(spark, sf_dir)
    rows = training.withColumn("label", text.normalise_label(F.col("label")))
    models = t.train_default(rows, expectations, stored_vocabulary(spark, sf_dir))
    return models.select("arch", "lesson", "n_rows", F.round("accuracy", 6).alias("accuracy"),
                         F.array_join(F.transform("coef", lambda c: F.round(c, 4)), " ").alias("coef"))


@query("slim_embedding_export", o.with_(o.RAW, o.EXPECT, o.VOCAB) + "SELECT lesson, word, round(list_sum(list_transform(vector, lambda x: round(x, 9))), 6) AS total FROM "
       f"(SELECT DISTINCT lesson, unnest(list_concat({o.tokens('ideal')}, {o.tokens('question')}, string_split(lower(ideal), ' '), ['que', 'la', '[NEG]'])) AS word FROM expect) "
       "JOIN vocab USING (word) WHERE in_slim")
def slim_embedding_export(spark, sf_dir):
    expectations = b.expectations(spark, sf_dir).select(
        "lesson", text.preprocess("ideal").alias("ideal_tokens"), text.preprocess("question").alias("question_tokens"),
        F.array("ideal").alias("archetypes"), F.array(F.lit("que + la"), F.lit("[NEG]")).alias("patterns"))
    slim = embedding.slim_embeddings(expectations, stored_vocabulary(spark, sf_dir))
    return slim.select("lesson", "word", F.round(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("training_summary", o.with_(o.RAW, COUNTED) + "SELECT lesson, count(*) AS n_expectations, round(avg(1 - bad / n), 6) AS mean_accuracy, "
       "string_agg(exp_num || '=' || CAST(n AS INT), ',' ORDER BY exp_num) AS expectations, 'lr2/' || lesson AS models FROM per GROUP BY lesson")
def training_summary(spark, sf_dir):
    rows = b.raw_training(spark, sf_dir).groupBy("lesson", "exp_num").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("label").isin("bad", "Bad "), 0.0).otherwise(1.0)).alias("share"))
    both = rows.withColumn("arch", F.lit("lr2"))
    summary = evaluation.training_summary(both.select("arch", "lesson", F.concat_ws("=", "exp_num", "n").alias("exp_num"), F.col("share").alias("accuracy")))
    return summary.select("lesson", "n_expectations", F.round("mean_accuracy", 6).alias("mean_accuracy"),
                          F.array_join("expectations.exp_num", ",").alias("expectations"), "models")


@query("data_replication", o.with_(o.RAW) + "SELECT lesson, exp_num, 4 * count(*) AS n, count(DISTINCT row_id) AS n_distinct, 4 * sum(length(text)) AS chars FROM raw GROUP BY ALL")
def data_replication(spark, sf_dir):
    rows = evaluation.replicate(b.raw_training(spark, sf_dir).withColumn("n_chars", F.length("text")).drop("text"), 4)
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_distinct"), F.sum("n_chars").alias("chars"))


_STATE = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'IN_PROGRESS' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' END"


@query("job_ledger", f"""WITH j AS (SELECT user_id // 2 AS job_id, {_STATE} AS status, ts, event_id FROM events),
       l AS (SELECT job_id, arg_max(status, event_id) AS status, min(ts) AS created, max(ts) AS updated, count(*) AS n_events FROM j GROUP BY job_id)
       SELECT c.job_id, coalesce(l.status, 'not found') AS status, coalesce(l.n_events, 0) AS n_events
       FROM (SELECT DISTINCT user_id AS job_id FROM events) c
       LEFT JOIN (SELECT * FROM l WHERE created + INTERVAL 20 DAY > TIMESTAMP '2024-01-21 12:00:00') l USING (job_id)""")
def job_ledger(spark, sf_dir):
    jobs = ledger.latest_status(job_events(b.table(spark, sf_dir, "events")))
    kept = ledger.unexpired(jobs, F.lit("2024-01-21 12:00:00").cast("timestamp_ntz"))
    asked = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id")).distinct()
    found = ledger.look_up(asked, kept)
    return found.select("job_id", "status", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def job_events(events):
    return events.select(
        F.expr("user_id div 2").alias("job_id"),
        F.expr(_STATE).alias("status"), F.col("ts").alias("at"), "event_id")


SCORED = """scored AS (SELECT f.answer_id, f.lesson, f.exp_num, coalesce(w.coef, d.coef) AS coef, coalesce(w.intercept, d.intercept) AS b,
  [neg, len(tokens) / 100.0::DOUBLE, CASE WHEN neg % 2 = 0 THEN 1.0 ELSE 0.0 END] AS x
  FROM (SELECT *, """ + o.negations("tokens") + " AS neg FROM (SELECT *, " + o.tokens("text") + """ AS tokens FROM fanned)) f
  CROSS JOIN dflt d LEFT JOIN own w USING (lesson, exp_num)),
decided AS (SELECT *, list_dot_product(CAST(x AS DOUBLE[]), CAST(coef AS DOUBLE[])) + b AS z FROM scored)"""
_SCORING = o.with_(o.RAW, o.EXPECT, o.ASKED, o.FANNED, COUNTED, SCORED)


def _scored_rows(spark, sf_dir):
    rows = lookup.fan_out(b.answers(spark, sf_dir), b.expectations(spark, sf_dir)).withColumn("arch", F.lit("lr2"))
    rows = rows.withColumn("tokens", text.preprocess("text"))
    x = F.array(text.negation_count(F.col("tokens")).cast("double"), F.size("tokens") / 100.0, text.negation_is_even(F.col("tokens")).cast("double"))
    return lookup.with_model(rows.withColumn("x", x), written(counted_models(spark, sf_dir), "models"))


@query("answer_probability", _SCORING + "SELECT answer_id, exp_num, round(1 / (1 + exp(-z)), 6) AS probability FROM decided")
def answer_probability(spark, sf_dir):
    z = scoring.decision(F.col("x"), F.col("coef"), F.col("intercept"))
    return _scored_rows(spark, sf_dir).select("answer_id", "exp_num", F.round(vectors.logistic(z), 6).alias("probability"))


@query("answer_decision", _SCORING + "SELECT answer_id, exp_num, CASE WHEN z > 0 THEN 'Good' ELSE 'Bad' END AS evaluation, "
       "round(1 / (1 + exp(-abs(z))), 6) AS score FROM decided")
def answer_decision(spark, sf_dir):
    scored = scoring.score(_scored_rows(spark, sf_dir))
    return scored.select("answer_id", "exp_num", "evaluation", F.round("score", 6).alias("score"))


def evaluated(spark, sf_dir, quality=fixed.TRAIN_QUALITY):
    training, expectations = inputs(spark, sf_dir)
    expectations = written(expectations, "given")
    vocabulary = stored_vocabulary(spark, sf_dir)
    trained = t.train(training, expectations, vocabulary, t.TrainingOptions(quality=quality))
    clean = training.withColumn("label", text.normalise_label(F.col("label")))
    default = t.train_default(clean, expectations, vocabulary)
    models = written(trained.models.unionByName(default), "models")
    return evaluate(b.answers(spark, sf_dir), trained.configs, models, vocabulary)


@query("batch_evaluation")
def batch_evaluation(spark, sf_dir):
    """Flagship: train all lessons and the default model, score all answers."""
    rows = evaluated(spark, sf_dir)
    return rows.select(
        "answer_id", *KEYS, "pos", "evaluation", F.round("score", 6).alias("score"), "own_model",
        F.col("metacognitive.evaluation").alias("metacognitive"), F.col("profanity.evaluation").alias("profanity"))
