"""Queries on single texts: labels, tokens, regexes, speech acts, config values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import config_values, text, vectors
from markwise.plans import bindings as b
from markwise.plans import oracle as o
from markwise.plans.registry import query

DOCS = "FROM documents"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", "text")


def joined(tokens):
    return F.md5(F.array_join(tokens, " "))


@query(
    "label_normalise",
    o.with_(o.RAW) + f"SELECT lesson, exp_num, {o.LABEL} AS label, count(*) AS n FROM raw "
    f"WHERE {o.LABEL} IN ('good', 'bad') GROUP BY ALL",
)
def label_normalise(spark, sf_dir):
    rows = b.raw_training(spark, sf_dir).withColumn("label", text.normalise_label(F.col("label")))
    rows = rows.filter(F.col("label").isin(fixed.GOOD, fixed.BAD))
    return rows.groupBy("lesson", "exp_num", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "answer_normalise",
    o.with_(o.RAW, o.CLEAN) + "SELECT lesson, exp_num, row_id, label, md5(text) AS text FROM clean",
)
def answer_normalise(spark, sf_dir):
    from markwise.operators.training_rows import clean_rows

    rows = clean_rows(b.raw_training(spark, sf_dir))
    return rows.select("lesson", "exp_num", "row_id", "label", F.md5("text").alias("text"))


@query("punctuation_normalise", f"SELECT doc_id, md5({o.punct('text')}) AS clean {DOCS}")
def punctuation_normalise(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.normalise_punctuation("text")).alias("clean"))


_DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
           "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
_TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def spelled(n: str) -> str:
    """SQL for the English words of an integer column below a thousand billions."""
    small = "array(" + ", ".join(f"'{w}'" for w in _DIGITS) + ")"
    tens = "array(" + ", ".join(f"'{w}'" for w in _TENS) + ")"

    def below_hundred(x: str) -> str:
        return (f"CASE WHEN {x} = 0 THEN '' WHEN {x} < 20 THEN {small}[int({x})] "
                f"ELSE trim(concat({tens}[int({x} div 10)], ' ', CASE WHEN {x} % 10 = 0 THEN '' ELSE {small}[int({x} % 10)] END)) END")

    def below_thousand(x: str) -> str:
        return (f"trim(concat(CASE WHEN {x} >= 100 THEN concat({small}[int({x} div 100)], ' hundred ') ELSE '' END, "
                f"{below_hundred(f'({x} % 100)')}))")

    def scale(size: int, word: str) -> str:
        group = f"({n} div {size} % 1000)"
        return f"CASE WHEN {n} div {size} % 1000 > 0 THEN concat({below_thousand(group)}, ' {word} ') ELSE '' END"

    scales = ", ".join(scale(size, word) for size, word in ((10**9, "billion"), (10**6, "million"), (10**3, "thousand")))
    return f"CASE WHEN {n} = 0 THEN 'zero' ELSE trim(concat({scales}, {below_thousand(f'({n} % 1000)')})) END"


def _shown(key: str) -> str:
    return f"CASE WHEN {key} = 1 THEN 'one' ELSE CAST({key} AS VARCHAR) END"


@query(
    "number_words",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' ELSE 'order ' END || "
    f"{_shown('o_orderkey')} || CASE WHEN o_orderkey % 2 = 0 THEN ' By Customer ' ELSE ' by customer ' END || "
    f"CASE WHEN o_orderkey % 2 = 0 AND o_custkey = 1 THEN 'One' ELSE {_shown('o_custkey')} END || CASE WHEN o_orderkey % 2 = 0 THEN ' Then 7' ELSE ' then 7' END AS text FROM orders",
)
def number_words(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    words = F.concat(
        F.lit("order "), F.expr(spelled("o_orderkey")), F.lit(" by customer "), F.expr(spelled("o_custkey")),
        F.lit(" then seven"),
    )
    words = F.when(F.col("o_orderkey") % 2 == 0, F.initcap(words)).otherwise(words)
    return orders.select("o_orderkey", words.alias("t")).select("o_orderkey", text.words_to_digits("t").alias("text"))


_DENOMINATORS = ["half", "thirds", "quarters", "fifths", "sixths", "sevenths", "eighths", "ninths", "tenths"]


def _ordinal_spelled(n: str) -> str:
    """Spark SQL: a number as the words of its ordinal."""
    irregular = "map('one', 'first', 'two', 'second', 'three', 'third', 'five', 'fifth', 'eight', 'eighth', 'nine', 'ninth', 'twelve', 'twelfth')"
    last = f"regexp_extract({spelled(n)}, '([a-z]+)$', 1)"
    return (f"concat(regexp_replace({spelled(n)}, '[a-z]+$', ''), coalesce({irregular}[{last}], "
            f"CASE WHEN {last} LIKE '%ty' THEN regexp_replace({last}, 'y$', 'ieth') ELSE concat({last}, 'th') END))")


@query("number_word_kinds",
       "SELECT o_orderkey, 'the ' || CASE o_orderkey WHEN 0 THEN 'zeroth' WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' ELSE o_orderkey || "
       "CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END END || "
       "' costs ' || o_custkey || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' or ' || o_custkey || '/' || (o_orderkey % 9 + 2) || ' more' AS text FROM orders")
def number_word_kinds(spark, sf_dir):
    """Ordinals, decimals and fractions spelled out, and back again."""
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    digits = "transform(split(lpad(CAST(o_orderkey % 1000 AS string), 3, '0'), ''), d -> array('zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine')[CAST(d AS int)])"
    parts = "array(" + ", ".join(f"'{w}'" for w in _DENOMINATORS) + ")"
    words = F.concat(
        F.lit("the "), F.expr(_ordinal_spelled("o_orderkey")), F.lit(" costs "), F.expr(spelled("o_custkey")), F.lit(" point "),
        F.expr(f"array_join({digits}, ' ')"), F.lit(" or "), F.expr(spelled("o_custkey")), F.lit(" "),
        F.expr(f"{parts}[CAST(o_orderkey % 9 AS int)]"), F.lit(" more"))
    return orders.select("o_orderkey", words.alias("t")).select("o_orderkey", text.words_to_digits("t").alias("text"))


@query("tokenise", f"SELECT doc_id, len(t) AS n, {o.joined('t')} AS tokens FROM "
       f"(SELECT doc_id, {o.split(o.punct('lower(text)'))} AS t {DOCS})")
def tokenise(spark, sf_dir):
    tokens = F.expr(text.tokens_sql(text.punctuation_sql("lower(text)")))
    return docs(spark, sf_dir).select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n"), joined("t").alias("tokens"))


@query("stop_word_removal", f"SELECT doc_id, len(t) AS n, {o.joined('t')} AS tokens FROM "
       f"(SELECT doc_id, {o.content(o.split('lower(text)'))} AS t {DOCS})")
def stop_word_removal(spark, sf_dir):
    tokens = F.expr(text.content_words_sql(text.tokens_sql("lower(text)")))
    return docs(spark, sf_dir).select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n"), joined("t").alias("tokens"))


_MAP = {"the": "der", "der": "le", "de": "of", "n't": "not"}


@query("word_map", f"SELECT doc_id, {o.joined('t')} AS tokens FROM (SELECT doc_id, list_transform({o.split('lower(text)')}, "
       "lambda w: CASE w " + " ".join(f"WHEN {o.lit(k)} THEN {o.lit(v)}" for k, v in _MAP.items()) + f" ELSE w END) AS t {DOCS})")
def word_map(spark, sf_dir):
    tokens = F.expr(text.mapped_words_sql(text.tokens_sql("lower(text)"), _MAP))
    return docs(spark, sf_dir).select("doc_id", joined(tokens).alias("tokens"))


@query("preprocess_sentence", f"SELECT doc_id, len(t) AS n, {o.joined('t')} AS tokens FROM (SELECT doc_id, {o.tokens('text')} AS t {DOCS})")
def preprocess_sentence(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.preprocess("text").alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n"), joined("t").alias("tokens"))


@query("negation_features", "SELECT doc_id, n AS negations, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS is_even FROM "
       f"(SELECT doc_id, {o.negations(o.tokens('text'))} AS n {DOCS})")
def negation_features(spark, sf_dir):
    tokens = docs(spark, sf_dir).select("doc_id", text.preprocess("text").alias("t"))
    return tokens.select(
        "doc_id", text.negation_count(F.col("t")).cast("bigint").alias("negations"),
        text.negation_is_even(F.col("t")).alias("is_even"))


@query("regex_hit_vector", o.with_(o.RAW, o.EXPECT) + "SELECT r.lesson, r.exp_num, r.row_id, array_to_string("
       f"list_concat({o.hits('r.text', 'e.good')}, {o.hits('r.text', 'e.bad')}), '') AS hits "
       "FROM raw r JOIN expect e USING (lesson, exp_num)")
def regex_hit_vector(spark, sf_dir):
    from markwise.operators.lookup import with_config

    rows = with_config(b.raw_training(spark, sf_dir), b.expectations(spark, sf_dir), "row_id")
    hits = F.concat(text.regex_hits(F.col("text"), F.col("good")), text.regex_hits(F.col("text"), F.col("bad")))
    return rows.select("lesson", "exp_num", "row_id", F.array_join(hits.cast("array<string>"), "").alias("hits"))


@query("regex_hit_ratio", o.with_(o.RAW, o.EXPECT) + "SELECT r.lesson, r.exp_num, r.row_id, "
       f"round({o.ratio('r.text', 'e.good')}, 6) AS good_ratio, round({o.ratio('r.text', 'e.bad')}, 6) AS bad_ratio "
       "FROM raw r JOIN expect e USING (lesson, exp_num)")
def regex_hit_ratio(spark, sf_dir):
    from markwise.operators.lookup import with_config

    rows = with_config(b.raw_training(spark, sf_dir), b.expectations(spark, sf_dir), "row_id")
    return rows.select(
        "lesson", "exp_num", "row_id",
        F.round(text.regex_hit_ratio(F.col("text"), F.col("good")), 6).alias("good_ratio"),
        F.round(text.regex_hit_ratio(F.col("text"), F.col("bad")), 6).alias("bad_ratio"))


_PATTERNS = ["die + und", "[NEG]", "a + [NEG]", "la", "que + el"]


@query("keyword_pattern_match", "SELECT doc_id, p AS pattern, CASE WHEN len(list_filter(string_split(p, '+'), lambda k: "
       "CASE WHEN trim(k) = '[NEG]' THEN n = 0 ELSE NOT list_contains(t, trim(k)) END)) = 0 THEN 1 ELSE 0 END AS hit "
       f"FROM (SELECT doc_id, t, {o.negations('t')} AS n FROM (SELECT doc_id, {o.tokens('text')} AS t {DOCS})), "
       f"(SELECT unnest([{', '.join(o.lit(p) for p in _PATTERNS)}]) AS p)")
def keyword_pattern_match(spark, sf_dir):
    tokens = docs(spark, sf_dir).select("doc_id", text.preprocess("text").alias("t"))
    each = tokens.select("doc_id", "t", F.explode(F.array(*[F.lit(p) for p in _PATTERNS])).alias("pattern"))
    return each.select("doc_id", "pattern", text.pattern_match(F.col("t"), F.col("pattern")).alias("hit"))


@query("key_case_conversion", """SELECT doc_id, lang AS exp_lang, n_chars AS text_n_chars,
       'src_' || lower(substr(source, 4)) AS source_key FROM documents""")
def key_case_conversion(spark, sf_dir):
    camel = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("docId"),
        F.struct(F.col("lang").alias("expLang"), F.struct(F.col("n_chars").alias("textNChars")).alias("textInfo")).alias("expInfo"),
        F.concat(F.lit("src"), F.regexp_replace("source", "^src", "N")).alias("sourceKey"),
    )
    renamed = config_values.rename_keys(camel)
    key = F.regexp_replace(config_values.snake_case_column(F.col("source_key")), "_n", "_")
    return renamed.select("doc_id", F.col("exp_info.exp_lang").alias("exp_lang"),
                          F.col("exp_info.text_info.text_n_chars").alias("text_n_chars"), key.alias("source_key"))


_WORDS = "'true', 'false', 'on', 'off', 'yes', 'no', '|'"


@query("feature_escaping", "SELECT doc_id, md5(array_to_string(list_transform(w, lambda v: CASE WHEN "
       f"{o.strip('lower(v)')} IN ({_WORDS}) THEN '|' || v ELSE v END), ' ')) AS escaped, "
       f"len(list_filter(w, lambda v: {o.strip('lower(v)')} IN ({_WORDS}))) AS n_escaped, true AS round_trip "
       "FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def feature_escaping(spark, sf_dir):
    words = docs(spark, sf_dir).select("doc_id", F.split("text", " ", -1).alias("w"))
    escaped = words.withColumn("e", config_values.escape_features(F.col("w")))
    changed = F.size(F.filter(F.arrays_zip("w", "e"), lambda p: p["w"] != p["e"]))
    return escaped.select(
        "doc_id", joined("e").alias("escaped"), changed.cast("bigint").alias("n_escaped"),
        (config_values.unescape_features(F.col("e")) == F.col("w")).alias("round_trip"))


@query("boolean_property", """SELECT event_id, v, lower(v) IN ('1', 't', 'true') AND v IS NOT NULL AS flag FROM (
       SELECT event_id, CASE WHEN event_type = 'signup' THEN 'TRUE' WHEN event_type = 'click' THEN 'yes'
       WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'T' ELSE CAST(user_id AS VARCHAR) END AS v FROM events)""")
def boolean_property(spark, sf_dir):
    value = (F.when(F.col("event_type") == "signup", "TRUE").when(F.col("event_type") == "click", "yes")
             .when(F.col("event_type") == "error", None).when(F.col("event_type") == "view", "T")
             .otherwise(F.col("user_id").cast("string")))
    rows = b.table(spark, sf_dir, "events").select("event_id", value.alias("v"))
    return rows.select("event_id", "v", config_values.flag(F.col("v")).alias("flag"))


@query("length_ratio", o.with_(o.RAW, o.EXPECT) + "SELECT lesson, exp_num, row_id, round(CASE WHEN len(i) > 0 THEN len(t) / len(i) "
       f"ELSE 0 END, 6) AS ratio FROM (SELECT r.lesson, r.exp_num, r.row_id, {o.tokens('r.text')} AS t, {o.tokens('e.ideal')} AS i "
       "FROM raw r JOIN expect e USING (lesson, exp_num))")
def length_ratio(spark, sf_dir):
    from markwise.operators.lookup import with_config

    ideals = b.expectations(spark, sf_dir).withColumn("i", text.preprocess("ideal"))
    rows = b.raw_training(spark, sf_dir).withColumn("t", text.preprocess("text"))
    return with_config(rows, ideals, "row_id").select(
        "lesson", "exp_num", "row_id", F.round(text.length_ratio(F.col("t"), F.col("i")), 6).alias("ratio"))


_SAID = [
    "Sorry, I can't follow this at all", "no idea", "I think it floats", "That is bullshit", "shit happens here",
    "we do not get it", "an assistant passed by", "The classic answer is copper", "maybe i guess so", "knotted rope",
    "Nothing was said", "I do not know",
]
_SENTENCES = (
    "sentences AS (SELECT 'document' AS origin, doc_id AS id, text FROM documents UNION ALL "
    "SELECT 'turn', conv_id * 1000 + turn, text FROM conversations UNION ALL "
    f"SELECT 'said', i, ([{', '.join(o.lit(s) for s in _SAID)}])[i] FROM range(1, {len(_SAID) + 1}) r(i))"
)


def sentences(spark, sf_dir):
    said = spark.createDataFrame([(i + 1, s) for i, s in enumerate(_SAID)], "id bigint, text string")
    turns = b.table(spark, sf_dir, "conversations")
    return (
        docs(spark, sf_dir).select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text")
        .unionByName(turns.select(F.lit("turn").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
        .unionByName(said.select(F.lit("said").alias("origin"), "id", "text"))
    )


def _re2(pattern: str) -> str:
    """The speech-act pattern without lookbehind, word edges written out."""
    inner = pattern[len(r"\b("): -len(r")\b")]
    start = inner.index("|(?<=n[o']t)")
    end = inner.index("|messed")
    after_not = inner[start:end][len(r"|(?<=n[o']t)\s?\b"):]
    inner = inner[:start] + inner[end:]
    word = r"[\pL\pN_]"
    edge = r"[^\pL\pN_]"
    both = f"((^|{edge})({inner})({edge}|$)|n[o']t\\s({after_not})({edge}|$))"
    return "(?i)" + both.replace(r"\w", word)


def _re2_plain(pattern: str) -> str:
    inner = pattern[len(r"\b("): -len(r")\b")]
    edge = r"[^\pL\pN_]"
    return "(?i)" + f"(^|{edge})({inner})({edge}|$)".replace(r"\w", r"[\pL\pN_]")


def _act(pattern: str) -> str:
    hit = f"regexp_matches(text, {o.lit(pattern)})"
    return (f"SELECT origin, id, CASE WHEN {hit} THEN 'Good' ELSE 'Bad' END AS evaluation, "
            f"CAST(CASE WHEN {hit} THEN 1 ELSE 0 END AS DOUBLE) AS score FROM sentences")


@query("speech_act_metacognitive", "WITH " + _SENTENCES + " " + _act(_re2(fixed.METACOGNITIVE)))
def speech_act_metacognitive(spark, sf_dir):
    return sentences(spark, sf_dir).select("origin", "id", text.metacognitive(F.col("text")).alias("a")).select(
        "origin", "id", "a.evaluation", "a.score")


@query("speech_act_profanity", "WITH " + _SENTENCES + " " + _act(_re2_plain(fixed.PROFANITY)))
def speech_act_profanity(spark, sf_dir):
    return sentences(spark, sf_dir).select("origin", "id", text.profanity(F.col("text")).alias("a")).select(
        "origin", "id", "a.evaluation", "a.score")


@query("embedding_rounding", "SELECT vec_id, i AS dim, round(CAST(embedding[i + 1] AS DOUBLE), 9) AS value "
       "FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def embedding_rounding(spark, sf_dir):
    rows = b.table(spark, sf_dir, "embeddings").select("vec_id", vectors.rounded(F.col("embedding").cast("array<double>")).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("dim", "value")).withColumn("dim", F.col("dim").cast("bigint"))
