"""Data before and after a language-model grader; the call itself is elsewhere."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise import schemas
from markwise.operators.lookup import first_configs
from markwise.operators.skew import salted_join


def ground_truth(training: DataFrame, expectations: DataFrame, limit: int = fixed.GROUND_TRUTH_LIMIT) -> DataFrame:
    """(lesson, answer_text, concepts): texts labelled for every expectation.

    Labels count only as exactly good/bad/Good/Bad; the last row of a text
    wins per expectation; the first ``limit`` texts of a lesson are used. The
    ``limit`` is applied before any lesson's texts meet in one task.
    """
    n_expected = expectations.groupBy("lesson").agg(F.countDistinct("exp_num").alias("n_expected"))
    sizes = training.groupBy("lesson", "text").agg(F.count(F.lit(1)).alias("n_rows"))
    valid = training.filter(F.col("label").isin("good", "bad", "Good", "Bad"))
    valid = salted_join(
        valid, expectations.select("lesson", "exp_num").distinct(), ["lesson", "exp_num"], "row_id", "left_semi"
    )
    last = valid.groupBy("lesson", "text", "exp_num").agg(F.max_by("label", "row_id").alias("label"))
    texts = last.groupBy("lesson", "text").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("exp_num", "label")))).alias("concepts")
    )
    texts = texts.join(sizes, ["lesson", "text"])
    texts = salted_join(texts, n_expected, ["lesson"], "text", "inner")
    complete = texts.filter((F.size("concepts") == F.col("n_expected")) & (F.col("n_rows") >= F.col("n_expected")))
    # the rank is cut inside each salt first, so no lesson is sorted in one task
    salted = complete.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(64)))
    inside = Window.partitionBy("lesson", "_salt").orderBy("text")
    survivors = salted.withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= limit)
    within = Window.partitionBy("lesson").orderBy("text")
    ranked = survivors.withColumn("_n", F.row_number().over(within)).filter(F.col("_n") <= limit)
    return ranked.select("lesson", F.col("text").alias("answer_text"), "concepts")


def concept_masks(expectations: DataFrame) -> DataFrame:
    """(lesson, exp_num, concept): the ids shown to the grader."""
    return first_configs(expectations).select(
        "lesson", "exp_num", F.concat(F.lit("concept_"), F.col("pos").cast("string")).alias("concept")
    )


def mask_ground_truth(truth: DataFrame, masks: DataFrame) -> DataFrame:
    """(lesson, answer_text, concept, known): ids masked, unknown ids dropped,
    labels as the strings True and False."""
    entries = truth.select("lesson", "answer_text", F.explode("concepts").alias("exp_num", "label"))
    known = F.when(F.lower("label") == fixed.GOOD, "True").otherwise("False")
    return entries.join(masks, ["lesson", "exp_num"]).select("lesson", "answer_text", "concept", known.alias("known"))


def lesson_prompts(expectations: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(lesson, concepts_json, truth_json): the parts of a prompt that only
    depend on the lesson. Ground truths are at most 100 texts per lesson."""
    masks = concept_masks(expectations)
    concepts = first_configs(expectations).join(masks, ["lesson", "exp_num"]).groupBy("lesson").agg(
        F.array_sort(F.collect_list(F.struct("pos", "concept", "ideal"))).alias("c")
    )
    concepts = concepts.select(
        "lesson",
        F.size("c").alias("n_concepts"),
        F.to_json(
            F.map_from_entries(F.transform("c", lambda e: F.struct(e["concept"], e["ideal"])))
        ).alias("concepts_json"),
    )
    if truth is None:
        return concepts.withColumn("truth_json", F.lit(None).cast("string"))
    answer = F.struct(
        "answer_text",
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("concept", "known")))).alias("concepts"),
    )
    per_text = mask_ground_truth(truth, masks).groupBy("lesson", "answer_text").agg(answer.alias("a"))
    truths = per_text.groupBy("lesson").agg(
        F.array_sort(F.collect_list(F.struct("answer_text", F.to_json("a").alias("json")))).alias("t")
    )
    quoted = F.transform(
        "t",
        lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["answer_text"])), r"(?s)^\[(.*)\]$", 1), F.lit(":"), e["json"]),
    )
    truths = truths.select(
        "lesson",
        F.concat(F.lit('{"training_answers":{'), F.array_join(quoted, ","), F.lit("}}")).alias("truth_json"),
    )
    return concepts.join(truths, "lesson", "left")


def prompts(answers: DataFrame, lessons: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(answer_id, lesson, n_concepts, messages, keep…): the ordered message array.

    A message array holds up to a hundred texts of its lesson, so what else is
    wanted of an answer (``keep``) should come along rather than be joined on later.
    """
    keep = keep or []
    joined = salted_join(answers.select("answer_id", "lesson", "text", *keep), lessons, ["lesson"], "answer_id", "inner")
    answer = F.to_json(F.create_map(F.lit("Answer 0"), F.struct(F.col("text").alias("Answer Text"))))

    def message(role: str, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(
        message("system", F.lit(fixed.PROMPT_SYSTEM)),
        message("user", F.col("concepts_json")),
        message("user", answer),
        message("user", F.lit(json.dumps(fixed.PROMPT_TEMPLATE))),
        message("user", F.lit(fixed.PROMPT_GUARDRAILS)),
        message("user", F.concat(F.lit(fixed.PROMPT_GROUND_TRUTH + "\n"), F.col("truth_json"))),
    )
    present = F.filter(messages, lambda m: m["content"].isNotNull())
    return joined.select("answer_id", "lesson", "n_concepts", present.alias("messages"), *keep)


def route(rows: DataFrame, chars_per_token: float = 4.0, limit: int = fixed.PROMPT_TOKEN_LIMIT) -> DataFrame:
    """Adds the token estimate and the model: the lesson's own choice, else by size."""
    chars = F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(m["content"]))
    tokens = F.ceil(chars / F.lit(chars_per_token))
    named = F.col("llm_model_name") if "llm_model_name" in rows.columns else F.lit(None).cast("string")
    sized = F.when(F.col("token_estimate") >= limit, fixed.PROMPT_MODEL_LARGE).otherwise(fixed.PROMPT_MODEL_SMALL)
    return rows.withColumn("token_estimate", tokens).withColumn("grader_model", F.coalesce(named, sized))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Adds ``answer`` (the first one) and ``valid`` to (…, response, n_concepts).

    Valid means: it parses, and the first answer has as many concepts as asked.
    """
    fixed_keys = F.regexp_replace("response", '"answer text"', '"answer_text"')
    parsed = responses.withColumn("_p", F.from_json(fixed_keys, schemas.GRADER_RESPONSE))
    first = F.get(F.map_values("_p.answers"), F.lit(0))
    has_answer = F.coalesce(F.size("_p.answers") > 0, F.lit(False))
    parsed = parsed.withColumn("answer", F.when(has_answer, first))
    complete = F.when(F.col("answer.concepts").isNotNull(), F.size("answer.concepts") == F.col("n_concepts"))
    return parsed.withColumn("valid", F.coalesce(complete, F.lit(False))).drop("_p")


def grader_results(parsed: DataFrame, masks: DataFrame) -> DataFrame:
    """(answer_id, lesson, exp_num, evaluation, score) of the valid responses."""
    rows = parsed.filter("valid").select(
        "answer_id", "lesson", F.explode("answer.concepts").alias("concept", "c")
    )
    known = F.lower("c.is_known") == "true"
    return salted_join(rows, masks, ["lesson", "concept"], "answer_id", "inner").select(
        "answer_id",
        "lesson",
        "exp_num",
        F.when(known, fixed.EVALUATION_GOOD).otherwise(fixed.EVALUATION_BAD).alias("evaluation"),
        F.col("c.confidence").alias("score"),
    )


def prefer_grader(graded: DataFrame, regression: DataFrame) -> DataFrame:
    """Per answer: all of the grader's rows where there are any, else the regression's."""
    answered = graded.select("answer_id").distinct()
    columns = ["answer_id", "exp_num", "evaluation", "score"]
    fallback = regression.join(answered, "answer_id", "left_anti").select(*columns, F.lit("regression").alias("source"))
    return graded.select(*columns, F.lit("grader").alias("source")).unionByName(fallback)
