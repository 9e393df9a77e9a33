import re

import pytest
from pyspark.sql import functions as F

from markwise.functions import config_values, text
from markwise.plans import bindings


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "sentence, tokens",
    [
        ("Sixty", ["60"]),
        ("fifty two times ninety", ["52", "times", "90"]),
        ("the clouds would not reach a valley", ["clouds", "would", "not", "reach", "a", "valley"]),
        ("I can't say 5% of a-b!", ["ca", "not", "say", "5", "percent", "a", "b"]),
        ("No, I did NOT.", ["no", "not"]),
    ],
)
def test_preprocess(spark, sentence, tokens):
    assert one(spark, sentence, lambda _: text.preprocess("v")) == tokens


@pytest.mark.parametrize(
    "words, digits",
    [
        ("one", "one"),
        ("two hundred and five apples", "205 apples"),
        ("one two three", "1 2 3"),
        ("three million two thousand nine hundred ninety nine", "3002999"),
        ("twenty thirty", "20 30"),
        ("a thousand and one nights", "a 1001 nights"),
        ("zero five", "0 5"),
        ("bone tent often", "bone tent often"),
        ("nineteen hundred", "19 100"),
        ("seven, or eight", "7, or 8"),
        ("the twenty first of nine", "the 21st of 9"),
        ("first", "first"),
        ("Second and third", "Second and third"),
        ("the fifth, the twelfth", "the 5th, the 12th"),
        ("one hundred and eleventh", "111th"),
        ("two thousandth try", "2000th try"),
        ("ninety-second", "92nd"),
        ("three second one", "3 second 1"),
        ("three point one four", "3.14"),
        ("zero point zero five percent", "0.05 percent"),
        ("twelve point five and six", "12.5 and 6"),
        ("the point one makes", "the point one makes"),
        ("one point made", "one point made"),
        ("two thirds of three quarters", "2/3 of 3/4"),
        ("one half", "1/2"),
        ("half of the quarters", "half of the quarters"),
        ("one two fifths", "1 2/5"),
        ("fifth halves", "5th halves"),
        ("twenty one hundredths", "21/100"),
        ("tenthly fourthold", "tenthly fourthold"),
    ],
)
def test_number_words(spark, words, digits):
    assert one(spark, words, lambda _: text.words_to_digits("v")) == digits


@pytest.mark.parametrize(
    "sentence, meta, profane",
    [
        ("We dont know how tides work", "Good", "Bad"),
        ("She did not understand why the ship turned", "Good", "Bad"),
        ("I believe the moon pulls at the sea", "Good", "Bad"),
        ("This fucking rope is wet", "Bad", "Good"),
        ("Where in hell is the anchor", "Bad", "Good"),
        ("I dont know, the engine is shit", "Good", "Good"),
        ("Assistants assist the captain", "Bad", "Bad"),
        ("élost", "Bad", "Bad"),
    ],
)
def test_speech_acts(spark, sentence, meta, profane):
    assert one(spark, sentence, text.metacognitive).evaluation == meta
    assert one(spark, sentence, text.profanity).evaluation == profane


def test_negation_matches_python_reading(spark):
    words = ["no", "éno", "not", "nothing", "none", "notable", "don't", "no.no", "aint*", "never_", "cant"]
    rx = r"\b(?:" + "|".join(text.fixed.NEGATION_WORDS) + r")\b"
    expected = len(re.findall(rx, re.sub("[.*']", "", " ".join(words))))
    assert one(spark, words, text.negation_count, "v array<string>") == expected
    assert one(spark, [], text.negation_is_even, "v array<string>") == 1


def test_regex_vector_and_ratio(spark):
    df = spark.createDataFrame(
        [("un élan group pressure", [r"\bgroup\b.*\bpressu\w*", r"\blan\b"]), ("x", [])], "t string, p array<string>"
    )
    rows = df.select(
        text.regex_hits(F.col("t"), F.col("p")).alias("h"), text.regex_hit_ratio(F.col("t"), F.col("p")).alias("r")
    ).collect()
    assert [(r.h, r.r) for r in rows] == [([1, 0], 0.5), ([], 0.0)]


def test_pattern_match(spark):
    df = spark.createDataFrame(
        [
            (["a", "not", "b"], "a + [NEG]"),
            (["a", "b"], "a + [NEG]"),
            (["a", "b"], "b + a"),
            (["ab"], "a"),
        ],
        "t array<string>, p string",
    )
    assert [r[0] for r in df.select(text.pattern_match(F.col("t"), F.col("p"))).collect()] == [1, 0, 1, 0]


def test_escape_round_trip(spark):
    raw = ["on", "off", "|", "on the way  ", " yes  ", "Yes", "   True", "OFF     ", "", "  "]
    kept = ["|on", "|off", "||", "on the way  ", "| yes  ", "|Yes", "|   True", "|OFF     ", "", "  "]
    assert one(spark, raw, config_values.escape_features, "v array<string>") == kept
    assert one(spark, kept, config_values.unescape_features, "v array<string>") == raw


def test_flags_and_keys(spark):
    df = spark.createDataFrame([("T",), ("yes",), (None,), ("TRUE",), ("1",)], "v string")
    assert [r[0] for r in df.select(config_values.flag(F.col("v"))).collect()] == [True, False, False, True, True]
    assert config_values.environment_flag("t") is False
    assert config_values.snake_case("expectationId") == "expectation_id"
    assert config_values.camel_case("expectation_results") == "expectationResults"
    nested = spark.createDataFrame([((1, [(2,)]),)], "aB struct<cD:int,eF:array<struct<gH:int>>>")
    assert config_values.rename_keys(nested).schema.simpleString() == (
        "struct<a_b:struct<c_d:int,e_f:array<struct<g_h:int>>>>"
    )


def test_no_python_in_text_plan(spark):
    df = spark.createDataFrame([("x y",)], "v string").select(text.preprocess("v").alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_order_keys_beyond_a_million_are_spelled_and_read_back(spark, tmp_path):
    from markwise.plans import catalog_text

    keys = [0, 1, 2, 999_999, 1_000_000, 1_000_001, 2_345_678, 36_000_007, 118_000_020, 999_999_999, 5_000_000_011]
    spark.createDataFrame([(k, 9_000_000 + k % 7) for k in keys], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    for r in catalog_text.number_words(spark, str(tmp_path)).collect():
        shown = "one" if r.o_orderkey == 1 else str(r.o_orderkey)
        assert r.text.lower() == f"order {shown} by customer {9_000_000 + r.o_orderkey % 7} then 7"
    kinds = {r.o_orderkey: r.text for r in catalog_text.number_word_kinds(spark, str(tmp_path)).collect()}
    assert kinds[2_345_678] == f"the 2345678th costs {9_000_000 + 2_345_678 % 7}.678 or {9_000_000 + 2_345_678 % 7}/{2_345_678 % 9 + 2} more"
    assert kinds[1_000_000].startswith("the 1000000th costs") and kinds[118_000_020].startswith("the 118000020th costs")


def test_vocabulary_is_normalised_once_a_run_between_spaces(spark, tmp_path):
    from markwise.plans import bindings

    texts = ["Can't STOP-now  won't", "a\tb\u00a0c\nd=e 5%", " \n", None, "", "\u039f\u0394\u039f\u03a3 x\u03a3 '\u03a3", "it's ~(ok)~\x1cgo\u2003on.", "isn't can't"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i)]) for i in range(5)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = bindings.vocabulary(spark, str(tmp_path))
    whole = F.explode(F.expr(text.tokens_sql(text.punctuation_sql("lower(text)"))))
    expected = spark.read.parquet(f"{tmp_path}/documents.parquet").select(whole.alias("word")).distinct()
    assert sorted(r.word for r in found.collect()) == sorted(r.word for r in expected.collect())
    # the patterns go over distinct runs, not over whole texts
    assert "lower(run" in found._jdf.queryExecution().analyzed().toString()


def test_number_words_are_tried_letter_by_letter():
    from markwise.functions import numbers

    for word in [*numbers.NUMBERS, *numbers.ORDINALS]:
        assert re.fullmatch(numbers._alternatives([*numbers.NUMBERS, *numbers.ORDINALS]), word)
    assert numbers._alternatives(["six", "sixth", "ten"]) == "s(?:i(?:x(?:t(?:h))?))|t(?:e(?:n))"


def test_runs_of_texts_once_each(spark, monkeypatch):
    monkeypatch.setattr(bindings, "CUT_BYTES", 40)
    monkeypatch.setattr(bindings, "RUNS_AT_ONCE", 6)
    monkeypatch.setattr(bindings, "HASHED_AT_ONCE", 2)
    texts = [None, "", " ", "a b\nc", "\n", "one two  one\n", "\u00e4 \u00f6\tx", "a" * 100, None, *[f"w{i} w{i % 7}" for i in range(60)]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    got = [r.run for r in bindings.distinct_runs(rows).collect() if r.run]
    want = {run for t in texts if t for run in t.replace("\n", " ").split(" ")} - {""}
    assert len(got) == len(set(got)) and set(got) == want
    assert bindings.distinct_runs(rows.filter("text = 'nowhere'")).count() == 0
