"""Queries of the data around a language-model grader, and of exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators import grader, scoring
from markwise.plans import bindings as b
from markwise.plans import oracle as o
from markwise.plans.catalog_joins import COUNTED, counted_models
from markwise.plans.catalog_training import inputs
from markwise.plans.export import model_extract
from markwise.plans.registry import query
from markwise.session import written

TRUTH = """labelled AS (SELECT lesson, text, exp_num, arg_max(label, row_id) AS label FROM raw WHERE label IN ('good', 'bad', 'Good', 'Bad') GROUP BY ALL),
complete AS (SELECT lesson, text, string_agg(exp_num || '=' || label, ',' ORDER BY exp_num) AS concepts FROM labelled GROUP BY ALL HAVING count(*) = 2),
truth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lesson ORDER BY text) AS k FROM complete) WHERE k <= 100)"""


@query("ground_truth_table", o.with_(o.RAW, TRUTH) + "SELECT lesson, md5(text) AS answer_text, concepts FROM truth")
def ground_truth_table(spark, sf_dir):
    truth = grader.ground_truth(*inputs(spark, sf_dir))
    entries = F.transform(F.map_entries("concepts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return truth.select("lesson", F.md5("answer_text").alias("answer_text"), F.array_join(F.array_sort(entries), ",").alias("concepts"))


@query("concept_masking", o.with_(o.RAW, o.EXPECT, TRUTH) + "SELECT t.lesson, md5(t.text) AS answer_text, 'concept_' || e.pos AS concept, "
       "CASE WHEN lower(l.label) = 'good' THEN 'True' ELSE 'False' END AS known "
       "FROM truth t JOIN labelled l USING (lesson, text) JOIN expect e USING (lesson, exp_num)")
def concept_masking(spark, sf_dir):
    training, expectations = inputs(spark, sf_dir)
    masked = grader.mask_ground_truth(grader.ground_truth(training, expectations), grader.concept_masks(expectations))
    return masked.select("lesson", F.md5("answer_text").alias("answer_text"), "concept", "known")


def _prompts(spark, sf_dir):
    training, expectations = inputs(spark, sf_dir)
    lessons = written(grader.lesson_prompts(expectations, grader.ground_truth(training, expectations)), "lesson_prompts")
    answers = b.answers(spark, sf_dir)
    named = answers.select("answer_id", F.when(F.col("lesson") == "fr", "lesson-model").alias("llm_model_name"))
    return grader.prompts(answers.join(named, "answer_id"), lessons, ["llm_model_name"])


@query("prompt_messages", o.with_(o.RAW, o.EXPECT, o.ASKED, TRUTH) + f"""SELECT answer_id, lesson, 6 AS n_messages, 'system,user,user,user,user,user' AS roles,
  md5(text) AS answer, (SELECT md5(string_agg('concept_' || pos || '=' || ideal, '|' ORDER BY pos)) FROM expect e WHERE e.lesson = a.lesson) AS concepts,
  (SELECT count(*) FROM truth t WHERE t.lesson = a.lesson) AS n_truths, {len(fixed.PROMPT_SYSTEM)} AS system_chars, true AS guarded FROM asked a""")
def prompt_messages(spark, sf_dir):
    """The message array taken apart again: order, roles and JSON contents."""
    m = _prompts(spark, sf_dir)
    content = lambda i: F.col("messages")[i]["content"]
    concepts = F.from_json(content(1), "map<string,string>")
    truth = F.regexp_extract(content(5), r"(?s)\n\n?(\{.*)$", 1)
    truths = F.from_json(truth, "training_answers map<string, struct<answer_text: string, concepts: map<string, string>>>")
    pairs = F.transform(F.map_entries(concepts), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.select(
        "answer_id", "lesson", F.size("messages").alias("n_messages"), F.array_join("messages.role", ",").alias("roles"),
        F.md5(F.from_json(content(2), "map<string, map<string,string>>")["Answer 0"]["Answer Text"]).alias("answer"),
        F.md5(F.array_join(F.array_sort(pairs), "|")).alias("concepts"),
        F.size(truths["training_answers"]).cast("bigint").alias("n_truths"), F.length(content(0)).alias("system_chars"),
        (content(4) == fixed.PROMPT_GUARDRAILS).alias("guarded"))


@query("prompt_size_routing", f"""SELECT doc_id, ceil((n_chars_ + {len(fixed.PROMPT_SYSTEM)}) / 4.0) AS token_estimate,
  CASE WHEN lang = 'fr' THEN 'lesson-model' WHEN ceil((n_chars_ + {len(fixed.PROMPT_SYSTEM)}) / 4.0) >= 4000 THEN 'gpt-4.1-mini' ELSE 'gpt-4o-mini' END AS grader_model
  FROM (SELECT *, length(text) AS n_chars_ FROM documents)""")
def prompt_size_routing(spark, sf_dir):
    """Whole documents as answers: the long ones go to the larger model."""
    docs = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("lang") == "fr", "lesson-model").alias("llm_model_name"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(fixed.PROMPT_SYSTEM).alias("content")),
                F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    return grader.route(docs).select("doc_id", F.col("token_estimate").cast("double").alias("token_estimate"), "grader_model")


RESPONSES = """said AS (SELECT answer_id, lesson, length(text) AS n FROM asked),
kinds AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'broken' WHEN n % 7 = 1 THEN 'short' WHEN n % 7 = 2 THEN 'empty' ELSE 'whole' END AS kind FROM said)"""


def responses(spark, sf_dir):
    """Grader responses of every kind: whole, short of a concept, empty, cut off."""
    n = F.length("text")
    rows = b.answers(spark, sf_dir).select("answer_id", "lesson", n.alias("n"), F.lit(2).alias("n_concepts"))
    concept = (
        "named_struct('is_known', CAST(n % {k} = 0 AS string), 'confidence', round((n % 40) / 100.0D + {c}D, 2), 'justification', 'because')"
    )
    first = f"named_struct('answer_text', 'it', 'concepts', map('concept_0', {concept.format(k=2, c=0.5)}, 'concept_1', {concept.format(k=3, c=0.25)}))"
    short = f"named_struct('answer_text', 'it', 'concepts', map('concept_0', {concept.format(k=2, c=0.5)}))"
    whole = F.expr(f"to_json(named_struct('answers', map('answer_1', {first}, 'answer_2', {short})))")
    less = F.expr(f"to_json(named_struct('answers', map('answer_1', {short}, 'answer_2', {first})))")
    kind = F.col("n") % 7
    response = (
        F.when(kind == 0, F.substring(whole, 1, 60)).when(kind == 1, less).when(kind == 2, F.lit('{"answers":{}}'))
        .otherwise(F.when(F.col("n") % 2 == 0, F.replace(whole, F.lit("answer_text"), F.lit("answer text"))).otherwise(whole))
    )
    return rows.withColumn("response", response)


@query("grader_response_parse", o.with_(o.ASKED, RESPONSES) + "SELECT answer_id, kind = 'whole' AS valid FROM kinds")
def grader_response_parse(spark, sf_dir):
    return grader.parse_responses(responses(spark, sf_dir)).select("answer_id", "valid")


GRADED = """graded AS (
  SELECT answer_id, lesson, '0' AS exp_num, CASE WHEN n % 2 = 0 THEN 'Good' ELSE 'Bad' END AS evaluation, (n % 40) / 100.0 + 0.5 AS score FROM kinds WHERE kind = 'whole'
  UNION ALL SELECT answer_id, lesson, '1', CASE WHEN n % 3 = 0 THEN 'Good' ELSE 'Bad' END, (n % 40) / 100.0 + 0.25 FROM kinds WHERE kind = 'whole')"""


def graded(spark, sf_dir):
    masks = grader.concept_masks(b.expectations(spark, sf_dir))
    return grader.grader_results(grader.parse_responses(responses(spark, sf_dir)), masks)


@query("grader_results", o.with_(o.ASKED, RESPONSES, GRADED) + "SELECT g.answer_id, g.exp_num, g.evaluation, round(CAST(g.score AS DOUBLE), 6) AS score, "
       "CASE WHEN regexp_matches(a.text, '(?i)(^|[^\\pL\\pN_])(\\w*fuck\\w*|hell|shit|idiot\\w*|stupid\\w*)([^\\pL\\pN_]|$)') THEN 'Good' ELSE 'Bad' END AS profanity "
       "FROM graded g JOIN asked a USING (answer_id)")
def grader_results(spark, sf_dir):
    rows = graded(spark, sf_dir).join(b.answers(spark, sf_dir).select("answer_id", "text"), "answer_id")
    acts = scoring.with_speech_acts(rows)
    return acts.select("answer_id", "exp_num", "evaluation", F.round("score", 6).alias("score"), F.col("profanity.evaluation").alias("profanity"))


@query("result_preference", o.with_(o.ASKED, RESPONSES, GRADED) + """SELECT answer_id, exp_num, evaluation, round(CAST(score AS DOUBLE), 6) AS score, 'grader' AS source FROM graded
  UNION ALL SELECT answer_id, e, 'Bad', 0.75, 'regression' FROM kinds, (SELECT unnest(['0', '1']) AS e) WHERE kind <> 'whole'""")
def result_preference(spark, sf_dir):
    fallback = b.answers(spark, sf_dir).select(
        "answer_id", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("exp_num"), F.lit("Bad").alias("evaluation"), F.lit(0.75).alias("score"))
    rows = grader.prefer_grader(graded(spark, sf_dir), fallback)
    return rows.select("answer_id", "exp_num", "evaluation", F.round("score", 6).alias("score"), "source")


@query("model_config_extract", o.with_(o.RAW, o.EXPECT, COUNTED) + "SELECT e.lesson, e.exp_num, round(coalesce(w.coef, d.coef)[1], 6) AS first_weight, "
       "round(coalesce(w.intercept, d.intercept), 6) AS bias, md5(e.ideal) AS ideal, array_to_string(e.good, ' ') AS regex_good, 0 AS n_patterns "
       "FROM expect e CROSS JOIN dflt d LEFT JOIN own w USING (lesson, exp_num)")
def model_config_extract(spark, sf_dir):
    """The exported JSON of each lesson, parsed again."""
    models = written(counted_models(spark, sf_dir), "models")
    extract = model_extract(b.expectations(spark, sf_dir), models)
    entry = ("weights_bias array<string>, ideal string, regex_good array<string>, regex_bad array<string>, "
             "archetype_good array<string>, archetype_bad array<string>, patterns_good array<string>, patterns_bad array<string>")
    parsed = extract.select("lesson", F.explode(F.from_json("extract", f"map<string, struct<{entry.replace(' array', ': array').replace(' double', ': double').replace(' string', ': string')}>>")).alias("exp_num", "e"))
    return parsed.select("lesson", "exp_num", F.round(F.from_json(F.col("e.weights_bias")[0], "array<double>")[0], 6).alias("first_weight"),
                         F.round(F.col("e.weights_bias")[1].cast("double"), 6).alias("bias"),
                         F.md5("e.ideal").alias("ideal"), F.array_join("e.regex_good", " ").alias("regex_good"), F.size("e.patterns_good").alias("n_patterns"))
