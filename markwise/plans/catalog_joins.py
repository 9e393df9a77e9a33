"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise.functions import text
from markwise.operators import alignment, density, embedding, evaluation, lookup, nearest, training_rows
from markwise.plans import bindings as b
from markwise.plans import oracle as o
from markwise.plans.registry import query
from markwise.session import written


@query("config_lookup", o.with_(o.RAW, o.EXPECT) + "SELECT r.lesson, r.e AS exp_num, r.row_id, md5(coalesce(e.ideal, '')) AS ideal, coalesce(e.pos, -1) AS pos FROM "
       "(SELECT lesson, row_id, CASE WHEN label = 'unsure' THEN '7' ELSE exp_num END AS e FROM raw) r "
       "LEFT JOIN expect e ON r.lesson = e.lesson AND r.e = e.exp_num")
def config_lookup(spark, sf_dir):
    expectations = b.expectations(spark, sf_dir)
    again = expectations.withColumn("pos", F.col("pos") + 10).withColumn("ideal", F.lit("a second entry of the same id"))
    rows = b.raw_training(spark, sf_dir).withColumn("exp_num", F.when(F.col("label") == "unsure", "7").otherwise(F.col("exp_num")))
    found = lookup.with_config(rows, again.unionByName(expectations), "row_id")
    return found.select("lesson", "exp_num", "row_id", F.md5("ideal").alias("ideal"), F.coalesce("pos", F.lit(-1)).alias("pos"))


@query("trainable_rows", o.with_(o.RAW, o.EXPECT, o.KEEP) + "SELECT lesson, exp_num, row_id, label FROM raw SEMI JOIN keep USING (lesson, exp_num)")
def trainable_rows(spark, sf_dir):
    training, expectations = b.raw_training(spark, sf_dir), b.expectations(spark, sf_dir)
    keep = training_rows.trainable(training, expectations)
    return lookup.trainable_rows(training, keep).select("lesson", "exp_num", "row_id", "label")


@query("vocabulary_join", o.with_(o.VOCAB) + "SELECT doc_id, count(*) AS n_known, md5(string_agg(word, ' ' ORDER BY word)) AS words FROM "
       f"(SELECT doc_id, unnest(list_distinct({o.tokens('text')})) AS word FROM documents) JOIN vocab USING (word) GROUP BY doc_id")
def vocabulary_join(spark, sf_dir):
    vocabulary = written(b.vocabulary(spark, sf_dir), "vocabulary")
    docs = b.table(spark, sf_dir, "documents").select("doc_id", text.preprocess("text").alias("tokens"))
    words = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word"))
    known = embedding.join_vocabulary(words, vocabulary, "doc_id").groupBy("doc_id").agg(
        F.array_sort(F.collect_list("word")).alias("w"))
    return known.select("doc_id", F.size("w").cast("bigint").alias("n_known"), F.md5(F.array_join("w", " ")).alias("words"))


@query("answer_fan_out", o.with_(o.RAW, o.EXPECT, o.ASKED, o.FANNED) + "SELECT answer_id, lesson, exp_num, coalesce(pos, -1) AS pos, md5(ideal) AS ideal FROM fanned")
def answer_fan_out(spark, sf_dir):
    rows = lookup.fan_out(b.answers(spark, sf_dir), b.expectations(spark, sf_dir))
    return rows.select("answer_id", "lesson", "exp_num", F.coalesce("pos", F.lit(-1)).alias("pos"), F.md5("ideal").alias("ideal"))


def counted_models(spark, sf_dir):
    """(arch, lesson, exp_num, coef, intercept): numbers counted from the rows,
    standing in for fitted coefficients; no own model where few are bad."""
    rows = b.raw_training(spark, sf_dir).groupBy("lesson", "exp_num").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("label").isin("bad", "Bad ")).cast("double")).alias("bad"))
    coef = F.array(-F.col("bad") / 10, F.col("bad") / F.col("n"), F.lit(0.25))
    own = rows.filter("bad >= 5").select(F.lit("lr2").alias("arch"), "lesson", "exp_num", coef.alias("coef"), (F.col("n") / 1000).alias("intercept"))
    total = rows.groupBy().agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    default = total.select(F.lit("lr2").alias("arch"), F.lit("default").alias("lesson"), F.lit("0").alias("exp_num"),
                           coef.alias("coef"), F.lit(-0.125).alias("intercept"))
    return own.unionByName(default)


COUNTED = """per AS (SELECT lesson, exp_num, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (label IN ('bad', 'Bad ')) AS DOUBLE) AS bad
  FROM raw GROUP BY lesson, exp_num),
own AS (SELECT lesson, exp_num, [-bad / 10, bad / n, 0.25] AS coef, n / 1000 AS intercept FROM per WHERE bad >= 5),
dflt AS (SELECT [-sum(bad) / 10, sum(bad) / sum(n), 0.25] AS coef, -0.125 AS intercept FROM per)"""


@query("model_fallback", o.with_(o.RAW, o.EXPECT, o.ASKED, o.FANNED, COUNTED) + "SELECT f.answer_id, f.exp_num, w.coef IS NOT NULL AS own_model, "
       "round(coalesce(w.coef, d.coef)[1], 6) AS first_coef, round(coalesce(w.intercept, d.intercept), 6) AS intercept "
       "FROM fanned f CROSS JOIN dflt d LEFT JOIN own w USING (lesson, exp_num)")
def model_fallback(spark, sf_dir):
    rows = lookup.fan_out(b.answers(spark, sf_dir), b.expectations(spark, sf_dir)).withColumn("arch", F.lit("lr2"))
    found = lookup.with_model(rows, written(counted_models(spark, sf_dir), "models"))
    return found.select("answer_id", "exp_num", "own_model", F.round(F.col("coef")[0], 6).alias("first_coef"),
                        F.round("intercept", 6).alias("intercept"))


@query("store_resolution", """SELECT source AS lesson, CASE WHEN en > 30 THEN 'local' WHEN fr > 6 THEN 'deployed' ELSE 'default' END AS origin,
       CASE WHEN en > 30 THEN en WHEN fr > 6 THEN fr ELSE total END AS weight, en <= 30 AND fr <= 6 AS is_default
       FROM (SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source),
       (SELECT count(*) AS total FROM documents)""")
def store_resolution(spark, sf_dir):
    """Sources as lessons: a local copy where English is frequent, a deployed
    one where French is, else the default."""
    docs = b.table(spark, sf_dir, "documents").select(F.col("source").alias("lesson"), "lang")
    per = docs.groupBy("lesson", "lang").agg(F.count(F.lit(1)).alias("weight"))
    local = per.filter("lang = 'en' AND weight > 30").select("lesson", "weight")
    deployed = per.filter("lang = 'fr' AND weight > 6").select("lesson", "weight")
    default = docs.groupBy().agg(F.count(F.lit(1)).alias("weight"))
    requested = docs.select("lesson").distinct()
    return lookup.resolve_store(requested, local, deployed, default).select("lesson", "origin", "weight", "is_default")


@query("radius_neighbours", "SELECT a.label, a.vec_id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label "
       "AND sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) ** 2))) <= 1.3 "
       "GROUP BY ALL")
def radius_neighbours(spark, sf_dir):
    """Points within the radius of each point, itself included, by label; the
    pairs are compared block by block and only counts leave a task."""
    points = b.table(spark, sf_dir, "embeddings").select(
        "label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return density.neighbour_counts(points, ["label"], 1.3).select("label", F.col("id").alias("vec_id"), "n")


@query("nearest_in_radius", "WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
       "d AS (SELECT a.label, a.vec_id, b.vec_id AS other, list_distance(a.v, b.v) AS far FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) "
       "SELECT label, vec_id, arg_min(other, (far, other)) AS neighbour, round(min(far), 6) AS distance FROM d WHERE far <= 1.3 GROUP BY ALL")
def nearest_in_radius(spark, sf_dir):
    """The nearest other point of each point's label, if it lies in the radius."""
    points = b.table(spark, sf_dir, "embeddings").select(
        "label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return nearest.nearest_within(points, ["label"], 1.3).select(
        "label", F.col("id").alias("vec_id"), "neighbour", F.round("distance", 6).alias("distance"))


@query("leftover_words", o.with_(o.RAW, o.EXPECT) + "SELECT lesson, exp_num, row_id, len(list_intersect(t, i)) AS n_shared, "
       "len(list_filter(t, lambda w: NOT list_contains(i, w))) AS n_answer_left, len(list_filter(i, lambda w: NOT list_contains(t, w))) AS n_ideal_left, "
       "md5(array_to_string(list_sort(list_filter(i, lambda w: NOT list_contains(t, w))), ' ')) AS ideal_left FROM "
       f"(SELECT r.lesson, r.exp_num, r.row_id, list_distinct({o.tokens('r.text')}) AS t, list_distinct({o.tokens('e.ideal')}) AS i "
       "FROM raw r JOIN expect e USING (lesson, exp_num))")
def leftover_words(spark, sf_dir):
    ideals = b.expectations(spark, sf_dir).withColumn("ideal_tokens", text.preprocess("ideal"))
    rows = b.raw_training(spark, sf_dir).withColumn("tokens", text.preprocess("text"))
    left = alignment.leftover_words(lookup.with_config(rows, ideals, "row_id"))
    size = lambda c: F.size(c).cast("bigint")
    return left.select(
        "lesson", "exp_num", "row_id", F.col("n_shared").cast("bigint").alias("n_shared"),
        size("answer_left").alias("n_answer_left"), size("ideal_left").alias("n_ideal_left"),
        F.md5(F.array_join(F.array_sort("ideal_left"), " ")).alias("ideal_left"))


@query("stale_models", """WITH c AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS trained_at, min(ts) FILTER (event_type = 'view') AS updated_at,
       max(ts) FILTER (event_type = 'purchase') AS now_trained, max(ts) FILTER (event_type = 'click') AS now_updated FROM events GROUP BY user_id)
       SELECT user_id AS lesson, coalesce(now_trained > trained_at, false) AS retrained, coalesce(now_updated > updated_at, false) AS edited FROM c
       WHERE trained_at IS NOT NULL AND updated_at IS NOT NULL AND (coalesce(now_trained > trained_at, false) OR coalesce(now_updated > updated_at, false))""")
def stale_models(spark, sf_dir):
    events = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("lesson"), "event_type", "ts")
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    cached = events.groupBy("lesson").agg(first("signup").alias("trained_at"), first("view").alias("updated_at")).filter(
        "trained_at IS NOT NULL AND updated_at IS NOT NULL")
    trained = events.filter("event_type = 'purchase'").select("lesson", F.col("ts").alias("trained_at"))
    edited = events.filter("event_type = 'click'").select("lesson", F.col("ts").alias("updated_at"))
    return lookup.stale_lessons(cached, trained, edited)


PREDICTED = f"""predicted AS (
  SELECT lesson, exp_num, row_id, CASE WHEN len(t) % 2 = 0 THEN 'Good' ELSE 'Bad' END AS evaluation, 0.5 + (len(t) % 50) / 100.0::DOUBLE AS score
  FROM (SELECT *, {o.split('text')} AS t FROM raw))"""
JUDGED = PREDICTED + """,
judged AS (
  SELECT p.lesson, p.exp_num, p.row_id, p.evaluation, p.score, r.label, r.label IN ('good', 'bad') AS gte,
    CASE WHEN r.label IN ('good', 'bad') THEN p.score >= 0.6 ELSE p.score < 0.6 END AS met,
    CASE WHEN r.label NOT IN ('good', 'bad') AND p.score < 0.6 THEN 'neutral' ELSE lower(p.evaluation) END AS observed
  FROM predicted p JOIN raw r USING (lesson, exp_num, row_id)),
failed AS (SELECT *, CASE WHEN met AND (label = '' OR observed = lower(label)) THEN 0 ELSE 1 END AS failed FROM judged)"""


def predicted(spark, sf_dir):
    """Evaluations made from text lengths, as a stand-in for a classifier."""
    n = F.size(text.tokenise("text"))
    return b.raw_training(spark, sf_dir).select(
        "lesson", "exp_num", "row_id", F.when(n % 2 == 0, "Good").otherwise("Bad").alias("evaluation"),
        (F.lit(0.5) + (n % 50) / 100.0).alias("score"))


def expected(spark, sf_dir):
    from markwise.sources.training_csv import expected_results

    return expected_results(b.raw_training(spark, sf_dir)).select("lesson", "exp_num", "row_id", "label", "comparison", "threshold")


@query("predictions_with_expected", o.with_(o.RAW, JUDGED) + "SELECT lesson, exp_num, row_id, evaluation, round(score, 6) AS score, label, failed FROM failed")
def predictions_with_expected(spark, sf_dir):
    matched = evaluation.match_expected(predicted(spark, sf_dir), expected(spark, sf_dir), ["lesson", "exp_num", "row_id"])
    return evaluation.failures(matched).select("lesson", "exp_num", "row_id", "evaluation", F.round("score", 6).alias("score"), "label", "failed")


@query("test_set_accuracy", o.with_(o.RAW, JUDGED) + "SELECT lesson, exp_num, count(*) AS n_expectations, round(1 - sum(failed) / count(*), 6) AS accuracy "
       "FROM failed GROUP BY ALL")
def test_set_accuracy(spark, sf_dir):
    matched = evaluation.match_expected(predicted(spark, sf_dir), expected(spark, sf_dir), ["lesson", "exp_num", "row_id"])
    result = evaluation.accuracy(matched, ["lesson", "exp_num"])
    return result.select("lesson", "exp_num", "n_expectations", F.round("accuracy", 6).alias("accuracy"))
