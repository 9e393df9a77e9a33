import random

import pytest
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators import evaluation, grader, lookup, patterns, skew
from markwise.sources import lesson_config, lesson_json, model_store, training_csv
from markwise.streaming.evaluate import split_requests

GROUP = "lesson string, exp_num string, label string, pattern string, score double"


WORDS = ["anchor", "boat", "coast", "deck", "ebb", "flood", "[NEG]"]


def some_patterns(rng, n):
    pairs = [f"{a} + {b}" for a in WORDS for b in WORDS if a < b]
    return sorted(rng.sample([*WORDS, *pairs], n))


def plain_deduplicated(scores, cutoff):
    """The rule, pattern by pattern in alphabetical order."""
    seen, kept = {}, []
    for pattern in sorted(scores):
        if scores[pattern] > cutoff:
            if not any(seen.get(word, -1) >= scores[pattern] for word in pattern.split(" + ")):
                kept.append(pattern)
            seen[pattern] = scores[pattern]
    return kept


def test_deduplication_is_the_rule(spark):
    rng = random.Random(2)
    groups = {str(g): {p: rng.randint(3, 10) / 10 for p in some_patterns(rng, 12)} for g in range(12)}
    scored = spark.createDataFrame([("l", g, "good", p, s) for g, own in groups.items() for p, s in own.items()], GROUP)
    got = patterns.deduplicate(scored, 0.55).collect()
    for g, own in groups.items():
        assert sorted(r.pattern for r in got if r.exp_num == g) == plain_deduplicated(own, 0.55)


def plain_chi_squared(hits, labels):
    share = {c: labels.count(c) / len(labels) for c in (0, 1)}
    total = sum(hits)
    if not total:
        return -1.0
    return sum((sum(h for h, y in zip(hits, labels, strict=True) if y == c) - share[c] * total) ** 2 / (share[c] * total) for c in (0, 1))


def test_selection_is_by_chi_squared(spark):
    rng = random.Random(6)
    said = [([w for w in WORDS[:6] if rng.random() < 0.4] + ["not"] * rng.randint(0, 1), rng.randint(0, 1)) for _ in range(15)]
    labels = [y for _, y in said]
    names = some_patterns(rng, 11)
    sentences = spark.createDataFrame(
        [("l", "0", i, y, s) for i, (s, y) in enumerate(said)], "lesson string, exp_num string, sentence bigint, y int, tokens array<string>")
    found = spark.createDataFrame([("l", "0", "good", p) for p in names], "lesson string, exp_num string, label string, pattern string")
    support = patterns.pattern_support(found, sentences).withColumn("n_good", F.lit(sum(labels))).withColumn("n_bad", F.lit(15 - sum(labels)))

    def hit(pattern, tokens):
        return all(("not" if word == "[NEG]" else word) in tokens for word in pattern.split(" + "))

    ranked = sorted(names, key=lambda p: (round(plain_chi_squared([int(hit(p, s)) for s, _ in said], labels), 9), p), reverse=True)
    for n in (1, 4, 7):
        assert {r.pattern for r in patterns.select_best(support, n).collect()} == set(ranked[:n])
    assert patterns.select_best(support, 11).count() == 11


def test_salted_join_keeps_left_rows(spark):
    many = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    few = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    joined = skew.salted_join(many, few, ["k"], "id")
    assert joined.count() == 1000 and joined.filter("v = 1").count() == 334
    assert skew.salted_join(many, few, ["k"], "id", "left_anti").count() == 665


def test_csv_keeps_quotes_newlines_and_padding(spark, tmp_path):
    rows = [("01", 'say "it",\nthen stop', " good"), ("1", "é", None)]
    training_csv.write_training(spark.createDataFrame(rows, "exp_num string, text string, label string"), str(tmp_path / "t"))
    assert sorted(map(tuple, training_csv.read_training(spark, str(tmp_path / "t")).collect())) == sorted(rows)
    strict = training_csv.expected_results(spark.createDataFrame(rows, "exp_num string, text string, label string"))
    assert {r.exp_num: (r.label, r.comparison) for r in strict.collect()} == {"01": (" good", "LT"), "1": ("", "LT")}
    loose = training_csv.expected_results(spark.createDataFrame(rows, "exp_num string, text string, label string"), strict=False)
    assert {r.exp_num: r.comparison for r in loose.collect()} == {"01": "GTE", "1": "LT"}


def test_export_levels_and_quoted_newlines(spark):
    csv = 'exp_num,text,label\n0,plain,Good\n1,"a ""b"",\nc",Bad\n'
    inner = {"trainingData": {"config": "{}", "training": csv}}
    import json

    docs = spark.createDataFrame([(1, json.dumps({"data": inner})), (2, json.dumps({"data": {"me": inner}}))], "id int, value string")
    rows = lesson_json.training_rows(lesson_json.unpack_exports(docs, "value"), ["id"]).orderBy("id", "exp_num").collect()
    assert [tuple(r) for r in rows] == [
        (i, e, t, lab) for i in (1, 2) for e, t, lab in (("0", "plain", "Good"), ("1", 'a "b",\nc', "Bad"))
    ]


def test_config_round_trip(spark):
    rows = spark.createDataFrame(
        [("l", "q?", 0, "a", "ideal", ["on", "x"], True), ("l", "q?", 1, "b", "other", [], False)],
        "lesson string, question string, pos int, exp_num string, ideal string, good array<string>, featureLengthRatio boolean")
    configs = lesson_config.config_json(rows)
    assert '"|on"' in configs.first().config
    back = lesson_config.explode_config(configs, ["lesson"]).orderBy("pos").collect()
    assert [(r.exp_num, r.ideal, r.good, r.featureLengthRatio) for r in back] == [("a", "ideal", ["on", "x"], True), ("b", "other", [], False)]


def test_model_store_replaces_only_named_lessons(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "arch string, lesson string, v int")
    model_store.save(frame([("lr2", "a", 1), ("lr2", "b", 1)]), path)
    model_store.save(frame([("lr2", "a", 2)]), path)
    stored = model_store.load(spark, path, "v int")
    assert {(r.lesson, r.v) for r in stored.collect()} == {("a", 2), ("b", 1)}
    gone = model_store.without(stored, frame([("lr2", "b", 0), ("lr2", "zz", 0)]))
    assert {r.lesson for r in gone.collect()} == {"a"}


def test_unknown_expectation_keeps_its_row(spark):
    expectations = spark.createDataFrame(
        [("l", "0", 0, "first"), ("l", "0", 5, "again"), ("l", "1", 1, "second")], "lesson string, exp_num string, pos int, ideal string")
    answers = spark.createDataFrame([("a", "l", None, "t"), ("b", "l", "9", "t"), ("c", "l", "", "t"), ("d", "zz", None, "t")],
                                    "answer_id string, lesson string, exp_num string, text string")
    rows = {(r.answer_id, r.exp_num, r.ideal) for r in lookup.fan_out(answers, expectations).collect()}
    assert rows == {("a", "0", "first"), ("a", "1", "second"), ("b", "9", ""), ("c", "0", "first"), ("c", "1", "second")}


def test_grader_response_of_the_service(spark):
    response = """{"answers": {"answer_1": {"answer text": "it explodes", "concepts": {
        "concept_0": {"is_known": "false", "confidence": 0.9, "justification": "no"},
        "concept_1": {"is_known": true, "confidence": 0.7, "justification": "yes"}}}}}"""
    rows = [("a", "l", response, 2), ("b", "l", response, 3), ("c", "l", "no json", 2), ("d", "l", '{"answers": {}}', 0), ("e", "l", None, 2)]
    parsed = grader.parse_responses(spark.createDataFrame(rows, "answer_id string, lesson string, response string, n_concepts int"))
    assert {r.answer_id: r.valid for r in parsed.collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
    masks = spark.createDataFrame([("l", "x", "concept_0"), ("l", "y", "concept_1")], "lesson string, exp_num string, concept string")
    results = {(r.exp_num, r.evaluation, r.score) for r in grader.grader_results(parsed, masks).collect()}
    assert results == {("x", "Bad", 0.9), ("y", "Good", 0.7)}


def test_ground_truth_rules(spark):
    rows = [
        ("l", "0", 1, "t1", "Good"), ("l", "1", 2, "t1", "bad"), ("l", "1", 3, "t1", "good"),
        ("l", "0", 4, "t2", "good"), ("l", "1", 5, "t2", " good"), ("l", "0", 6, "t3", "bad"), ("l", "9", 7, "t3", "bad"),
    ]
    training = spark.createDataFrame(rows, "lesson string, exp_num string, row_id bigint, text string, label string")
    expectations = spark.createDataFrame([("l", "0", 0, "i"), ("l", "1", 1, "j")], "lesson string, exp_num string, pos int, ideal string")
    assert [(r.answer_text, r.concepts) for r in grader.ground_truth(training, expectations).collect()] == [("t1", {"0": "Good", "1": "good"})]


def test_failures_follow_the_bounds(spark):
    rows = [
        ("GTE", 0.6, "good", "Good", 0.7, 0), ("GTE", 0.6, "good", "Good", 0.5, 1), ("GTE", 0.6, "bad", "Good", 0.9, 1),
        ("LT", 0.6, "", "Good", 0.55, 0), ("LT", 0.6, "", "Good", 0.61, 1), ("LT", 0.6, "Good", "Good", 0.55, 1),
        ("EQ", 0.76, "good", "Good", 0.764, 0),
    ]
    df = spark.createDataFrame(rows, "comparison string, threshold double, label string, evaluation string, score double, want int")
    assert all(r.failed == r.want for r in evaluation.failures(df).collect())
    empty = evaluation.accuracy(df.filter("false"), [])
    assert empty.first().accuracy == 0.0


def test_rejected_requests(spark):
    df = spark.createDataFrame([("a", "l", "t"), ("b", None, "t"), ("c", "", "t"), ("d", "l", None)], "answer_id string, lesson string, text string")
    valid, invalid = split_requests(df)
    assert [r.answer_id for r in valid.collect()] == ["a"] and invalid.count() == 3


def test_plans_have_no_cross_join_and_no_python_where_columns_do(spark, small_dir):
    from __spark_entry__ import queries

    for name in ("preprocess_sentence", "regex_hit_ratio", "answer_decision", "answer_fan_out", "test_set_accuracy"):
        plan = queries()[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan, name


def test_fixed_thresholds():
    assert (fixed.MIN_GRADED_ROWS, fixed.CLUSTER_MIN_SAMPLES, fixed.GROUND_TRUTH_LIMIT) == (10, 5, 100)


def test_false_certificates_are_found(spark):
    from markwise.operators.alignment import alignment_certificates, checked_certificates

    vocabulary = spark.createDataFrame(
        [("red", [1.0, 0.0]), ("pink", [0.9, 0.1]), ("blue", [0.0, 1.0]), ("navy", [0.2, 0.8]), ("sky", [0.4, 0.6])],
        "word string, vector array<float>")
    rows = spark.createDataFrame(
        [(1, "l", ["pink", "navy", "odd"]), (2, "l", ["sky"]), (3, "l", ["odd", "sky", "navy", "pink"])], "row_id int, lesson string, tokens array<string>")
    ideals = spark.createDataFrame([("l", ["red", "blue", "new"])], "lesson string, ideal_tokens array<string>")
    found = alignment_certificates(rows, ideals, vocabulary, "row_id", ["lesson"], 2).cache()

    def feasible(certificates):
        checked = checked_certificates(certificates, ideals, vocabulary, "row_id", ["lesson"]).collect()
        return {r.row_id: r.feasible and abs(r.primal - r.dual) < 1e-6 for r in checked}

    assert feasible(found) == {1: True, 2: True, 3: True}
    lowered = found.withColumn("ideal_prices", F.transform("ideal_prices", lambda p: p - 0.1))
    assert not any(feasible(lowered).values())
    swapped = found.withColumn("partner", F.reverse("partner"))
    assert not feasible(swapped)[1]
    doubled = found.withColumn("partner", F.transform("partner", lambda _: F.lit(0)))
    assert not feasible(doubled)[1] and not feasible(doubled)[3]


def test_unknown_features_are_kept_through_yaml_and_json(spark):
    config = """
question: what?
expectations:
- expectation_id: a
  ideal: an ideal
  features:
    good: ['|on', x]
    featureLengthRatio: true
    ideal: "with \\"quotes\\", and: colons"
    weights: {b: [1, 2.5], "a key": null}
- expectation_id: b
"""
    rows = spark.createDataFrame([("l", config)], "lesson string, config string")
    first = lesson_config.explode_config(lesson_config.configs_from_yaml(rows), ["lesson"])
    for table in (first, lesson_config.explode_config(lesson_config.config_json(first), ["lesson"])):
        a, b = table.orderBy("pos").collect()
        assert (a.good, a.featureLengthRatio, b.extras, b.good, b.exp_num) == (["on", "x"], True, {}, [], "b")
        assert a.extras == {"ideal": '"with \\"quotes\\", and: colons"', "weights": '{"a key":null,"b":[1,2.5]}'}


def test_training_csv_keeps_every_character_and_reads_service_files(spark, tmp_path):
    rows = [("0", "naïve “quoted” – 日本\nline", "good"), ("01", "Größe, ½", "bad")]
    training_csv.write_training(spark.createDataFrame(rows, "exp_num string, text string, label string"), str(tmp_path / "u"))
    assert sorted(map(tuple, training_csv.read_training(spark, str(tmp_path / "u")).collect())) == sorted(rows)
    (tmp_path / "s.csv").write_bytes('exp_num,text,label\n01,"Größe, ½\nline",bad\n'.encode("latin-1"))
    read = training_csv.read_training(spark, str(tmp_path / "s.csv"), encoding=training_csv.SERVICE_ENCODING)
    assert [tuple(r) for r in read.collect()] == [("01", "Größe, ½\nline", "bad")]


def test_training_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training_csv, "FILE_ROWS", 100)
    rows = spark.range(450).repartition(1).selectExpr("'0' AS exp_num", "concat('a\n', id) AS text", "'good' AS label")
    training_csv.write_training(rows, str(tmp_path / "t"))
    sizes = [training_csv.read_training(spark, str(f)).count() for f in (tmp_path / "t").glob("*.csv")]
    assert sum(sizes) == 450 and max(sizes) == 100


def test_prompts_bring_along_what_is_kept(spark):
    from markwise.operators import grader

    answers = spark.createDataFrame([("1-1", "l", "it floats", "own"), ("1-2", "l", "it sinks", None)], "answer_id string, lesson string, text string, llm_model_name string")
    lessons = spark.createDataFrame([("l", 1, "{}", None)], "lesson string, n_concepts int, concepts_json string, truth_json string")
    found = grader.prompts(answers, lessons, ["llm_model_name"])
    assert {r.answer_id: r.llm_model_name for r in found.collect()} == {"1-1": "own", "1-2": None}
    assert all(len(r.messages) == 5 for r in found.collect())
