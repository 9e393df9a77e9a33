import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import text
from markwise.operators import alignment, assembly, evaluation
from markwise.plans import architectures, training
from markwise.plans.evaluate import evaluate
from markwise.plans.export import model_extract
from markwise.session import written

SUBJECT = ["heat", "fire", "flame", "warmth"]
VERB = ["melts", "softens", "liquefies"]
THING = ["wax", "candle", "paraffin"]
WRONG = ["cold", "ice", "wind", "snow", "rain"]


@pytest.fixture(scope="module")
def lesson(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(36):
        rows.append(("candle", "0", i, f"The {rng.choice(SUBJECT)} {rng.choice(VERB)} the {rng.choice(THING)}", rng.choice(["good", "Good ", "GOOD"])))
        rows.append(("candle", "0", 100 + i, f"The {rng.choice(WRONG)} does not {rng.choice(['touch', 'reach'])} anything", "bad"))
        if i < 12:
            rows.append(("candle", "1", 200 + i, f"{rng.choice(THING)} burns {'brightly' if i % 2 else 'never'}", "good" if i % 2 else "bad"))
        if i < 6:
            rows.append(("candle", "2", 300 + i, "too few rows", "good"))
    rows.append(("candle", "0", 400, "not counted", "perhaps"))
    vectors = {}
    for group in (SUBJECT, VERB, THING, WRONG, ["touch", "reach", "burns", "brightly", "anything"]):
        centre = rng.normal(size=8)
        for word in group:
            vectors[word] = (centre + rng.normal(size=8) * 0.2).astype(np.float32).tolist()
    frame = lambda r, s: written(spark.createDataFrame(r, s), "fixture")
    return {
        "training": frame([tuple(map(lambda v: v.item() if isinstance(v, np.generic) else v, r)) for r in rows],
                          "lesson string, exp_num string, row_id bigint, text string, label string"),
        "expectations": frame(
            [("candle", "0", 0, "What happens to the candle?", "Heat melts the wax.", [r"\bmelt\w*"], [r"\bnot\b"]),
             ("candle", "1", 1, "What happens to the candle?", "", [], []),
             ("candle", "2", 2, "What happens to the candle?", "The wick burns.", [], [])],
            "lesson string, exp_num string, pos int, question string, ideal string, good array<string>, bad array<string>"),
        "vocabulary": frame([(w, True, v) for w, v in vectors.items()], "word string, in_slim boolean, vector array<float>"),
    }


@pytest.fixture(scope="module")
def trained(lesson):
    return training.train(**lesson)


def test_models_and_accuracy(trained):
    models = {r.exp_num: r for r in trained.models.collect()}
    assert set(models) == {"0", "1"}  # "2" has too few rows
    assert models["0"].accuracy > 0.95
    assert models["0"].n_rows == 36 + 36 + 1 + 1  # graded, ideal, all concepts
    assert models["1"].n_rows == 12 + 1  # no ideal, so no ideal row


def test_config_carries_generated_features(trained):
    configs = {r.exp_num: r for r in trained.configs.collect()}
    assert configs["0"][fixed.FEATURE_PATTERNS_ENABLED] and configs["0"][fixed.FEATURE_ARCHETYPE_ENABLED]
    assert configs["0"].archetype_good and len(configs["0"].patterns_good) <= 10
    widths = {r.exp_num: r.w for r in trained.features.groupBy("exp_num").agg(F.max(F.size("x")).alias("w")).collect()}
    lists = ("archetype_good", "archetype_bad", "patterns_good", "patterns_bad")
    for exp, width in widths.items():
        assert width == 7 + sum(len(configs[exp][name]) for name in lists)
    untrained = configs["2"]  # stays in the config, with nothing generated
    assert untrained.ideal == "The wick burns." and not any(untrained[name] for name in lists)
    assert not untrained[fixed.FEATURE_ARCHETYPE_ENABLED] and not untrained[fixed.FEATURE_PATTERNS_ENABLED]


def test_predictions_and_fallback(spark, lesson, trained):
    default = training.train_default(
        lesson["training"].withColumn("label", F.trim(F.lower("label"))), lesson["expectations"], lesson["vocabulary"])
    models = written(trained.models.unionByName(default), "models")
    answers = spark.createDataFrame(
        [("good", "candle", "0", "the flame liquefies the paraffin"), ("bad", "candle", "0", "snow does not reach anything"),
         ("all", "candle", None, "I dont know"), ("unknown", "candle", "9", "what the hell")],
        "answer_id string, lesson string, exp_num string, text string")
    rows = evaluate(answers, trained.configs, models, lesson["vocabulary"]).collect()
    found = {(r.answer_id, r.exp_num): r for r in rows}
    assert set(found) == {("good", "0"), ("bad", "0"), ("all", "0"), ("all", "1"), ("all", "2"), ("unknown", "9")}
    assert found["good", "0"].evaluation == "Good" and found["bad", "0"].evaluation == "Bad"
    assert all(r.score >= 0.5 for r in rows)
    assert not found["all", "2"].own_model and not found["unknown", "9"].own_model
    assert found["all", "0"].metacognitive.evaluation == "Good" and found["unknown", "9"].profanity.evaluation == "Good"


def test_replicated_data_does_not_lower_accuracy(lesson, trained):
    twice = evaluation.replicate(lesson["training"], 2).withColumn("row_id", F.col("row_id") * 2 + F.col("copy")).drop("copy")
    again = training.train(twice, lesson["expectations"], lesson["vocabulary"], training.TrainingOptions(quality=0))
    before = training.train(**lesson, options=training.TrainingOptions(quality=0))
    one, two = ({r.exp_num: r.accuracy for r in m.models.collect()} for m in (before, again))
    assert all(two[e] >= one[e] for e in one)


def test_large_group_path_gives_the_same_models(lesson):
    options = training.TrainingOptions(quality=0)
    small = training.train(**lesson, options=options).models
    large = training.train(**lesson, options=training.TrainingOptions(quality=0, local_rows=40)).models
    a, b = ({r.exp_num: r for r in m.collect()} for m in (small, large))
    for exp in a:
        assert np.allclose(a[exp].coef, b[exp].coef, atol=1e-6) and a[exp].accuracy == b[exp].accuracy


def test_developer_mode_trains_what_it_can(lesson):
    rows = training.training_set(lesson["training"], lesson["expectations"], developer_mode=True)
    assert {r.exp_num for r in rows.select("exp_num").distinct().collect()} == {"0", "1", "2"}


def test_lesson_without_question_is_refused(lesson):
    with pytest.raises(ValueError):
        training.train(lesson["training"], lesson["expectations"].withColumn("question", F.lit("")), lesson["vocabulary"])


def test_export_holds_models_and_embeddings(trained):
    row = model_extract(trained.configs, trained.models, trained.embeddings).first()
    extract, embedding = json.loads(row.extract), json.loads(row.embedding)
    assert set(extract) == {"0", "1", "2"} and len(extract["0"]["weights_bias"][0]) >= 7
    assert "wax" in embedding and len(embedding["wax"]) == 8


def test_alignment_against_python(spark, lesson):
    rng = np.random.default_rng(3)
    words = SUBJECT + VERB + THING + WRONG + ["x", "y", "z"]
    vector = {r.word: np.array(r.vector) for r in lesson["vocabulary"].collect()}
    answers = [(f"a{i}", "l", "0", rng.choice(words, size=rng.integers(0, 6)).tolist()) for i in range(40)]
    ideal = ["heat", "melts", "wax", "x"]
    df = written(spark.createDataFrame(answers, "k string, lesson string, exp_num string, tokens array<string>"), "a")
    ideals = written(spark.createDataFrame([("l", "0", ideal)], "lesson string, exp_num string, ideal_tokens array<string>"), "i")
    got = {r.k: r.alignment for r in alignment.word_alignment(df, ideals, lesson["vocabulary"], "k", ["lesson", "exp_num"], 8).collect()}

    def similar(a, b):
        if a not in vector or b not in vector:
            return 0.0
        return float(vector[a] @ vector[b] / np.linalg.norm(vector[a]) / np.linalg.norm(vector[b]))

    def best(left, right):
        if len(left) > len(right):
            return best_t(right, left)
        return best_t(left, right)

    def best_t(short, long):
        if not short:
            return 0.0
        return max(similar(short[0], w) + best_t(short[1:], [v for v in long if v != w]) for w in long)

    for k, _, _, tokens in answers:
        left, right = sorted(set(tokens) - set(ideal)), sorted(set(ideal) - set(tokens))
        want = 1.0 if not right else (4 - len(right) + best(left, right)) / 4
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_length_ratio_and_regex_flags_widen_the_vector(lesson):
    base = training.TrainingOptions(quality=0)
    wide = training.TrainingOptions(quality=0, length_ratio=True, regex_vector=True)
    size = lambda o: training.train(**lesson, options=o).features.filter("exp_num = '0'").select(F.max(F.size("x"))).first()[0]
    assert size(base) == 7 and size(wide) == 8  # one regex each way stands for two ratios


def test_composite_prefers_the_grader(spark, lesson, trained):
    response = json.dumps({"answers": {"answer_1": {"answer_text": "t", "concepts": {
        "concept_0": {"is_known": "false", "confidence": 0.9, "justification": ""},
        "concept_1": {"is_known": "true", "confidence": 0.7, "justification": ""},
        "concept_2": {"is_known": "true", "confidence": 0.6, "justification": ""}}}}})
    answers = spark.createDataFrame([("g", "candle", None, "wax"), ("r", "candle", None, "wax melts")],
                                    "answer_id string, lesson string, exp_num string, text string")
    responses = spark.createDataFrame([("g", "candle", response), ("r", "candle", "late")], "answer_id string, lesson string, response string")
    run = architectures.ARCHITECTURES[fixed.ARCH_COMPOSITE].evaluate
    rows = run(answers, trained.configs, trained.models, lesson["vocabulary"], responses).collect()
    assert {(r.answer_id, r.source) for r in rows} == {("g", "grader"), ("r", "regression")}
    assert {(r.exp_num, r.evaluation) for r in rows if r.answer_id == "g"} == {("0", "Bad"), ("1", "Good"), ("2", "Good")}


def test_vocabulary_beyond_the_broadcast_limit(lesson):
    from markwise.operators import embedding

    said = training.sentences(training.training_set(lesson["training"], lesson["expectations"]))
    words = said.select("sentence", F.explode("tokens").alias("word"))
    joined = [embedding.join_vocabulary(words, lesson["vocabulary"], "sentence", limit) for limit in (1 << 20, 0)]
    assert joined[0].count() == joined[1].count() > 0
    assert assembly.KEYS == ["lesson", "exp_num"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_training_set_is_planned_from_few_sources(lesson):
    """Expectations and keys to keep are tables; their sources are not planned again for each use."""
    found = lesson["training"].groupBy("lesson", "exp_num").agg(F.min("text").alias("ideal"))
    expectations = found.withColumns({"pos": F.lit(0), "question": F.lit("why"), "good": F.array(F.lit("a")), "bad": F.array(F.lit("b"))})
    rows = training.training_set(lesson["training"], expectations)
    sources = [line for line in _plan(rows).splitlines() if "Relation" in line and "label#" in line]
    assert len(sources) == 1
    assert rows.filter("place = 2").count() > 0


def test_labels_are_not_lowered_by_the_planner(spark):
    """The driver's first use of lower takes hundreds of MB for tables of all letters."""
    label = F.when(F.col("id") == 0, " GOOD ").otherwise("Bad ")
    labels = spark.range(2).select(text.normalise_label(label).alias("label"))
    assert "lower(" in _plan(labels)
    assert sorted(r.label for r in labels.collect()) == ["bad", "good"]
