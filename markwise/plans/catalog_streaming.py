"""Queries of scoring with stored tables, as a batch and as a stream, and the streamed ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators import grader
from markwise.plans import bindings as b
from markwise.plans import oracle as o
from markwise.plans.catalog_grader import GRADED, RESPONSES, responses
from markwise.plans.catalog_text import _re2, _re2_plain
from markwise.plans.catalog_training import job_events, stored_vocabulary
from markwise.plans.evaluate import Store, evaluate, evaluate_resolved
from markwise.plans.registry import query
from markwise.session import fresh_path, written
from markwise.streaming.composite import composite_stream, regression_results
from markwise.streaming.evaluate import evaluate_stream
from markwise.streaming.ledger import ledger_stream

KEYS = ["lesson", "exp_num"]


def seven_wide_models(spark, sf_dir):
    """Seven coefficients per model, counted from the labelled rows. The one of
    the alignment is 0, so that SQL can check the scores."""
    rows = b.raw_training(spark, sf_dir).groupBy(*KEYS).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("label").isin("bad", "Bad ").cast("double")).alias("bad"))
    coef = F.array(-F.col("bad") / F.col("n"), F.lit(0.25), F.lit(0.0), F.lit(3.0), F.lit(-2.0), F.lit(1.5), -F.col("bad") / 10)
    own = rows.filter("bad >= 5").select(F.lit("lr2").alias("arch"), *KEYS, coef.alias("coef"), (F.col("n") / 1000).alias("intercept"))
    total = rows.groupBy().agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    default = total.select(F.lit("lr2").alias("arch"), F.lit("default").alias("lesson"), F.lit("").alias("exp_num"), coef.alias("coef"), F.lit(-0.125).alias("intercept"))
    return own.unionByName(default)


_COEF = "[-{bad} / {n}, 0.25, 0, 3, -2, 1.5, -{bad} / 10]"
_SEVEN = f"""per AS (SELECT lesson, exp_num, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (label IN ('bad', 'Bad ')) AS DOUBLE) AS bad FROM raw GROUP BY ALL),
own AS (SELECT lesson, exp_num, {_COEF.format(bad='bad', n='n')} AS coef, n / 1000 AS intercept FROM per WHERE bad >= 5),
dflt AS (SELECT {_COEF.format(bad='sum(bad)', n='sum(n)')} AS coef, -0.125 AS intercept FROM per),
asked_t AS (SELECT answer_id, {o.tokens('text')} AS tokens FROM asked),
et AS (SELECT lesson, exp_num, {o.tokens('ideal')} AS it FROM expect),
qt AS (SELECT lesson, {o.tokens('max(question)')} AS tokens FROM expect GROUP BY lesson)"""
_WIDE = f"""wide AS (
  SELECT f.*, asked_t.tokens, {o.negations('asked_t.tokens')} AS neg, coalesce({o.cosine('am.vector', 'im.vector')}, 0) AS si, {o.cosine('am.vector', 'qm.vector')} AS sq,
    CASE WHEN f.good IS NULL THEN 0 ELSE {o.ratio('f.text', 'f.good')} END AS rg, CASE WHEN f.bad IS NULL THEN 0 ELSE {o.ratio('f.text', 'f.bad')} END AS rb,
    w.coef IS NOT NULL AS own_model, coalesce(w.coef, d.coef) AS coef, coalesce(w.intercept, d.intercept) AS b
  FROM fanned f JOIN asked_t USING (answer_id) JOIN am USING (answer_id) JOIN qm ON f.lesson = qm.lesson
  LEFT JOIN im ON f.lesson = im.lesson AND f.exp_num = im.exp_num
  CROSS JOIN dflt d LEFT JOIN own w ON f.lesson = w.lesson AND f.exp_num = w.exp_num),
decided AS (SELECT *, list_dot_product(CAST([neg, CASE WHEN neg % 2 = 0 THEN 1 ELSE 0 END, 0, si, sq, rg, rb] AS DOUBLE[]), CAST(coef AS DOUBLE[])) + b AS z FROM wide),
results AS (SELECT answer_id, exp_num, coalesce(pos, -1) AS pos, CASE WHEN z > 0 THEN 'Good' ELSE 'Bad' END AS evaluation,
  round(1 / (1 + exp(-abs(z))), 6) AS score, own_model,
  CASE WHEN regexp_matches(text, {o.lit(_re2(fixed.METACOGNITIVE))}) THEN 'Good' ELSE 'Bad' END AS metacognitive,
  CASE WHEN regexp_matches(text, {o.lit(_re2_plain(fixed.PROFANITY))}) THEN 'Good' ELSE 'Bad' END AS profanity FROM decided)"""
RESULTS = o.with_(
    o.RAW, o.EXPECT, o.ASKED, o.FANNED, o.VOCAB, _SEVEN,
    o.means("asked_t", "answer_id", "tokens", "am"), o.means("et", "lesson, exp_num", "it", "im"), o.means("qt", "lesson", "tokens", "qm"), _WIDE)


def shown(rows):
    return rows.select("answer_id", "exp_num", "pos", "evaluation", F.round("score", 6).alias("score"), "own_model",
                       F.col("metacognitive.evaluation").alias("metacognitive"), F.col("profanity.evaluation").alias("profanity"))


def tables(spark, sf_dir):
    configs = written(b.expectations(spark, sf_dir), "configs")
    return configs, written(seven_wide_models(spark, sf_dir), "models"), stored_vocabulary(spark, sf_dir)


@query("stored_model_evaluation", RESULTS + "SELECT * FROM results")
def stored_model_evaluation(spark, sf_dir):
    """Fan-out, features, own or default model, scores and speech acts."""
    return shown(evaluate(b.answers(spark, sf_dir), *tables(spark, sf_dir)))


_UNTRAINED = (
    RESULTS.replace("expect AS (", "given AS (", 1)
    .replace("asked AS (", """expect AS (SELECT * FROM given UNION ALL
  SELECT DISTINCT lesson, '7', 7, question, NULL, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM given),
asked AS (""", 1)
    .replace("WHERE bad >= 5)", "WHERE bad >= 5 AND exp_num = '0')", 1)
)


@query("untrained_evaluation", _UNTRAINED + "SELECT * FROM results")
def untrained_evaluation(spark, sf_dir):
    """Scores for all expectations of the config, trained or not: one has no
    model, and one has neither a model nor an ideal nor training rows."""
    configs, models, vocabulary = tables(spark, sf_dir)
    bare = configs.select("lesson", "question").distinct().select(
        "lesson", F.lit("7").alias("exp_num"), F.lit(7).alias("pos"), "question", F.lit(None).cast("string").alias("ideal"),
        *[F.expr("CAST(array() AS array<string>)").alias(name) for name in ("good", "bad")])
    trained = models.filter("exp_num = '0' OR lesson = 'default'")
    both = written(configs.unionByName(bare), "configs")
    return shown(evaluate(b.answers(spark, sf_dir), both, written(trained, "models"), vocabulary))


_RESOLVED = RESULTS.replace(
    "n / 1000 AS intercept FROM per WHERE bad >= 5", "n / CASE lesson WHEN 'es' THEN 500 ELSE 1000 END AS intercept FROM per WHERE bad >= 5 AND lesson <> 'de'")


@query("resolved_evaluation", _RESOLVED + "SELECT * FROM results")
def resolved_evaluation(spark, sf_dir):
    """Lessons scored from where their models are: two from the local store, one that only the
    deployed store has, and one without models by the default model."""
    configs, models, vocabulary = tables(spark, sf_dir)

    def store(lessons, times):
        own = models.filter(F.col("lesson").isin(lessons)).withColumn("intercept", F.col("intercept") * times)
        return Store(configs.filter(F.col("lesson").isin(lessons)), own)

    rows = evaluate_resolved(b.answers(spark, sf_dir), configs, store(["en", "fr"], 1), store(["fr", "es"], 2), models, vocabulary)
    return shown(rows)


@query("streaming_evaluation", RESULTS + "SELECT answer_id, exp_num, evaluation, score FROM results UNION ALL "
       "SELECT conv_id || '-' || turn, NULL, 'rejected', NULL FROM conversations WHERE role <> 'user'")
def streaming_evaluation(spark, sf_dir):
    """The same as a stream over the turns; only user turns name a lesson."""
    turns = b.table_stream(spark, sf_dir, "conversations")
    lesson = F.element_at(F.lit(b.LESSONS), (F.col("conv_id") % len(b.LESSONS) + 1).cast("int"))
    answers = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.when(F.col("role") == "user", lesson).alias("lesson"),
        F.when(F.col("conv_id") % 2 == 1, (F.col("turn") % 3).cast("string")).alias("exp_num"), "text")
    stored = tables(spark, sf_dir)
    results, rejected = fresh_path(spark, "results"), fresh_path(spark, "rejected")
    stream = evaluate_stream(answers, lambda: stored, results, rejected, fresh_path(spark, "stream"), once=True)
    stream.awaitTermination()
    scored = spark.read.parquet(results).select("answer_id", "exp_num", "evaluation", F.round("score", 6).alias("score"))
    refused = spark.read.parquet(rejected).select(
        "answer_id", F.lit(None).cast("string").alias("exp_num"), F.lit("rejected").alias("evaluation"), F.lit(None).cast("double").alias("score"))
    return scored.unionByName(refused)


# every answer is asked at a time of its own; responses come up to 20 seconds later
_DELAY = "CAST('0x' || substr(md5(answer_id), 1, 5) AS BIGINT) % 20001"
_COMPOSITE = RESULTS.rstrip() + f""",
{RESPONSES},
{GRADED},
in_time AS (SELECT answer_id FROM kinds WHERE kind = 'whole' AND {_DELAY} <= 10000)
SELECT answer_id, exp_num, evaluation, round(CAST(score AS DOUBLE), 6) AS score, 'grader' AS source FROM graded SEMI JOIN in_time USING (answer_id)
UNION ALL SELECT answer_id, exp_num, evaluation, score, 'regression' FROM results ANTI JOIN in_time USING (answer_id)"""


def timed(rows):
    """Adds asked and came: a second per conversation and turn, a delay by the id's hash."""
    conversation, turn = F.split_part("answer_id", F.lit("-"), F.lit(1)), F.split_part("answer_id", F.lit("-"), F.lit(2))
    second = conversation.cast("bigint") * 60 + turn.cast("bigint")
    delay = F.conv(F.substring(F.md5("answer_id"), 1, 5), 16, 10).cast("bigint") % 20001
    asked = F.timestamp_seconds(F.lit(1_700_000_000) + second)
    return rows.withColumn("asked", asked).withColumn("came", F.timestamp_millis(F.unix_millis("asked") + delay))


def as_stream(rows, name):
    """A table as a stream of its rows; then a row a day later lets the watermark pass them all."""
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, name)
    time = next(field.name for field in rows.schema if field.name in ("asked", "came"))
    last = rows.groupBy().agg(F.max(time) + F.expr("INTERVAL 1 DAY"))
    empty = {"string": F.lit("")}
    closing = last.toDF(time).select(*[F.col(c) if c == time else empty.get(t, F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
    rows.unionByName(closing).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


#: Answers whose state a partition of a stream holds, at least.
STATE_ROWS = 20_000


def started(writer, rows):
    """Starts a stream whose state is as many partitions as the table ``rows`` asks for, within those the session has:
    a partition's stores write files in every batch, however little they hold."""
    spark, name = rows.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(spark.sparkContext.defaultParallelism, rows.count() // STATE_ROWS + 1))))
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


@query("composite_stream", _COMPOSITE)
def composite_streaming(spark, sf_dir):
    """Regression scores of all answers joined with a stream of grader responses, half of which come too late."""
    answers = b.answers(spark, sf_dir)
    configs, models, vocabulary = tables(spark, sf_dir)
    scores = evaluate(answers, configs, models, vocabulary)
    asked = timed(answers.select("answer_id")).select("answer_id", "asked")
    came = timed(responses(spark, sf_dir)).select("answer_id", "lesson", "came", "response", "n_concepts")
    masks = written(grader.concept_masks(configs), "masks")
    joined = composite_stream(as_stream(regression_results(scores, asked), "answers"), as_stream(came, "responses"), masks)
    path = fresh_path(spark, "composite")
    writer = (
        joined.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True)
    )
    started(writer, asked).awaitTermination()
    rows = spark.read.schema(joined.schema).parquet(path).filter("answer_id <> ''")
    return rows.select("answer_id", F.explode("results").alias("r"), "source").select(
        "answer_id", "r.exp_num", "r.evaluation", F.round("r.score", 6).alias("score"), "source")


# a job's records: the first begins with its first event, the next with the first event 20 days or more later
_LEDGER = """WITH RECURSIVE j AS (
  SELECT user_id // 2 AS job_id, epoch_ms(ts) // 1000 AS s, event_id, ts, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'IN_PROGRESS'
    WHEN 'click' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILURE' END AS status FROM events),
begun(job_id, s, k) AS (
  SELECT job_id, min(s), 0 FROM j GROUP BY job_id
  UNION ALL SELECT job_id, s, k + 1 FROM (
    SELECT b.job_id, b.k, (SELECT min(j.s) FROM j WHERE j.job_id = b.job_id AND j.s >= b.s + 20 * 86400) AS s FROM begun b) WHERE s IS NOT NULL),
owned AS (SELECT j.*, (SELECT max(b.s) FROM begun b WHERE b.job_id = j.job_id AND b.s <= j.s) AS began FROM j)
SELECT job_id, began, arg_max(status, (ts, event_id)) AS status, count(*) AS n_events,
  (began + 20 * 86400) * 1000 <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events) OR EXISTS (SELECT 1 FROM begun b WHERE b.job_id = owned.job_id AND b.s > began) AS expired
FROM owned GROUP BY job_id, began"""


@query("streaming_job_ledger", _LEDGER)
def streaming_job_ledger(spark, sf_dir):
    """All records that jobs ever had, the last ones with what has become of them."""
    events = b.table_stream(spark, sf_dir, "events")
    updates = ledger_stream(job_events(events).withColumn("at", F.col("at").cast("timestamp")))
    path = fresh_path(spark, "ledger")
    stream = (
        updates.writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
        .option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    began = F.unix_seconds("created").alias("began")
    latest = spark.read.parquet(path).groupBy("job_id", began).agg(F.max_by(F.struct("status", "n_events", "expired"), F.struct("batch", "expired")).alias("l"))
    return latest.select("job_id", "began", "l.status", "l.n_events", "l.expired")
