"""Queries that write given tables in the service's formats and scan them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators.skew import salted_join
from markwise.plans import bindings as b
from markwise.plans import oracle as o
from markwise.plans.registry import query
from markwise.session import fresh_path, written
from markwise.sources import lesson_config, lesson_json, model_store, training_csv, versions


@query("training_csv_scan", o.with_(o.RAW) + "SELECT exp_num, label, md5(text) AS text, length(text) AS n_chars FROM raw")
def training_csv_scan(spark, sf_dir):
    path = fresh_path(spark, "training-csv")
    training_csv.write_training(b.raw_training(spark, sf_dir).select("exp_num", "text", "label"), path)
    rows = training_csv.read_training(spark, path)
    return rows.select("exp_num", "label", F.md5("text").alias("text"), F.length("text").cast("bigint").alias("n_chars"))


@query("lesson_export_scan", o.with_(o.RAW) + "SELECT row_id AS lesson, exp_num, label, md5(text) AS text, 2 AS n_expectations FROM raw")
def lesson_export_scan(spark, sf_dir):
    """Each labelled document as a lesson export of its own, scanned back."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat_ws(",", "exp_num", quoted, F.concat(F.lit('"'), "label", F.lit('"')))
    lessons = b.raw_training(spark, sf_dir).groupBy("row_id").agg(
        F.array_join(F.array_sort(F.collect_list(record)), "\n").alias("csv"))
    config = F.to_json(F.struct(F.lit("why?").alias("question"), F.expr(
        "array(named_struct('expectationId', '0'), named_struct('expectationId', '1'))").alias("expectations")))
    parts = F.struct(config.alias("config"), F.concat(F.lit("exp_num,text,label\n"), "csv").alias("training"))
    document = F.to_json(F.struct(F.struct(F.struct(parts.alias("trainingData")).alias("me")).alias("data"), "row_id"))
    path = fresh_path(spark, "exports")
    lessons.select(document.alias("value")).write.text(path)
    lines = spark.read.text(path).withColumn("lesson", F.get_json_object("value", "$.row_id").cast("bigint"))
    exports = lesson_json.unpack_exports(lines, "value")
    counts = lesson_config.explode_config(exports, ["lesson"]).groupBy("lesson").agg(F.count("exp_num").alias("n_expectations"))
    rows = lesson_json.training_rows(exports, ["lesson"])
    return rows.join(counts, "lesson").select("lesson", "exp_num", "label", F.md5("text").alias("text"), "n_expectations")


@query("all_lessons_scan", o.with_(o.RAW, o.EXPECT) + "SELECT r.exp_num, r.label, md5(r.text) AS text, md5(e.question) AS question, "
       "md5(e.ideal) AS ideal FROM raw r JOIN expect e USING (lesson, exp_num)")
def all_lessons_scan(spark, sf_dir):
    # a lesson may hold most of the rows
    expectations = written(b.expectations(spark, sf_dir), "expectations")
    rows = salted_join(b.raw_training(spark, sf_dir), expectations, ["lesson", "exp_num"], "row_id", "inner")
    path = fresh_path(spark, "all-lessons")
    data = F.to_json(F.struct("question", "ideal")).alias("exp_data")
    training_csv.write_training(rows.select("exp_num", "text", "label", data), path)
    read = training_csv.read_default_training(spark, path)
    return read.select("exp_num", "label", *[F.md5(c).alias(c) for c in ("text", "question", "ideal")])


@query("lesson_config_scan", o.with_(o.RAW, o.EXPECT) + "SELECT lesson, pos, exp_num, md5(question) AS question, md5(ideal) AS ideal, "
       "array_to_string(good, ' ') AS good, array_to_string(bad, ' ') AS bad, exp_num = '1' AS aggregate_disabled FROM expect")
def lesson_config_scan(spark, sf_dir):
    configs = lesson_config.config_json(
        b.expectations(spark, sf_dir).withColumn("featureRegexAggregateDisabled", F.col("exp_num") == "1"))
    path = fresh_path(spark, "configs")
    configs.select("lesson", "config").write.partitionBy("lesson").text(path)
    rows = lesson_config.explode_config(lesson_config.read_configs(spark, path), ["lesson"])
    return rows.select(
        "lesson", "pos", "exp_num", F.md5("question").alias("question"), F.md5("ideal").alias("ideal"),
        F.array_join("good", " ").alias("good"), F.array_join("bad", " ").alias("bad"),
        F.col("featureRegexAggregateDisabled").alias("aggregate_disabled"))


def _yaml(column):
    """A text as a quoted YAML scalar on one line."""
    return F.concat(F.lit("\""), F.replace(F.replace(F.regexp_replace(column, r"\s+", " "), F.lit("\\"), F.lit("\\\\")), F.lit("\""), F.lit("\\\"")), F.lit("\""))


@query("lesson_yaml_scan", o.with_(o.RAW, o.EXPECT) + "SELECT lesson, pos, exp_num, md5(trim(regexp_replace(ideal, '\\s+', ' ', 'g'))) AS ideal, array_to_string(good, ' ') AS good, "
       "exp_num = '1' AS length_ratio, '{\"by\":[\"on\",' || pos || ']}' AS note, length(regexp_replace(ideal, '\\s+', ' ', 'g')) AS ideal_chars, 2 AS n_extras FROM expect")
def lesson_yaml_scan(spark, sf_dir):
    """Configs as YAML files, with features under names that have no column; they are
    read, written as JSON, and read again."""
    item = F.concat(
        F.lit("- expectationId: '"), F.col("exp_num"), F.lit("'\n  ideal: "), _yaml("ideal"),
        F.lit("\n  features:\n    good:\n"), F.array_join(F.transform("good", lambda g: F.concat(F.lit("    - "), _yaml(g))), "\n"),
        F.lit("\n    featureLengthRatio: "), F.when(F.col("exp_num") == "1", "yes").otherwise("no"),
        F.lit("\n    note:\n      by: ['on', "), F.col("pos").cast("string"), F.lit("]\n    ideal: "), _yaml("ideal"))
    files = b.expectations(spark, sf_dir).groupBy("lesson").agg(
        F.max("question").alias("question"), F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("items"))
    content = F.concat(F.lit("question: "), _yaml("question"), F.lit("\nexpectations:\n"), F.array_join("items.item", "\n"))
    path, again = fresh_path(spark, "yaml"), fresh_path(spark, "json")
    files.select("lesson", content.alias("config")).write.partitionBy("lesson").text(path)
    first = lesson_config.explode_config(lesson_config.read_configs(spark, path, yaml=True), ["lesson"])
    lesson_config.config_json(first).write.partitionBy("lesson").text(again)
    rows = lesson_config.explode_config(lesson_config.read_configs(spark, again), ["lesson"])
    return rows.select(
        "lesson", "pos", "exp_num", F.md5(F.trim("ideal")).alias("ideal"), F.array_join("good", " ").alias("good"),
        F.col("featureLengthRatio").alias("length_ratio"), F.col("extras")["note"].alias("note"),
        F.length(F.from_json(F.concat(F.lit('{"v":'), F.col("extras")["ideal"], F.lit("}")), "v string")["v"]).alias("ideal_chars"),
        F.size("extras").alias("n_extras"))


@query("word_vector_scan", o.with_(o.VOCAB) + "SELECT word, in_slim, round(list_sum(vector), 6) AS total, len(vector) AS width FROM vocab")
def word_vector_scan(spark, sf_dir):
    total = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v)
    return b.vocabulary(spark, sf_dir).select(
        "word", "in_slim", F.round(total, 6).alias("total"), F.size("vector").cast("bigint").alias("width"))


@query("test_set_scan", o.with_(o.RAW) + "SELECT exp_num, md5(text) AS text, coalesce(l, '') AS label, CASE WHEN l IN ('good', 'bad') "
       "THEN 'GTE' ELSE 'LT' END AS comparison, 0.6::DOUBLE AS threshold FROM "
       "(SELECT exp_num, text, CASE WHEN label <> 'unsure' THEN label END AS l FROM raw)")
def test_set_scan(spark, sf_dir):
    path = fresh_path(spark, "test-set")
    rows = b.raw_training(spark, sf_dir).select("exp_num", "text", F.when(F.col("label") != "unsure", F.col("label")).alias("label"))
    training_csv.write_training(rows, path)
    return training_csv.expected_results(training_csv.read_training(spark, path)).select(
        "exp_num", F.md5("text").alias("text"), "label", "comparison", "threshold")


def _counted_models(spark, sf_dir, version: int):
    rows = b.raw_training(spark, sf_dir).groupBy("lesson", "exp_num").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return rows.select(F.lit(fixed.ARCH_REGRESSION).alias("arch"), "lesson", "exp_num", "n", "chars", F.lit(version).alias("version"))


MODELS = "models AS (SELECT 'lr2' AS arch, lesson, exp_num, count(*) AS n, sum(length(text)) AS chars FROM raw GROUP BY lesson, exp_num)"
STORED = "exp_num string, n bigint, chars bigint, version int"


@query("model_store_save", o.with_(o.RAW, MODELS) + "SELECT *, CASE WHEN lesson IN ('en', 'fr') THEN 2 ELSE 1 END AS version FROM models")
def model_store_save(spark, sf_dir):
    path = fresh_path(spark, "models")
    model_store.save(_counted_models(spark, sf_dir, 1), path)
    model_store.save(_counted_models(spark, sf_dir, 2).filter(F.col("lesson").isin("en", "fr")), path)
    return model_store.load(spark, path, STORED).select("arch", "lesson", "exp_num", "n", "chars", "version")


_SHOWN = """shown AS (
  SELECT 'models' AS kind, lesson, exp_num, n AS value FROM models
  UNION ALL SELECT 'configs', lesson, exp_num, length(ideal) FROM expect)"""
_READERS = """SELECT 'first' AS reader, kind, lesson, exp_num, value, 1 AS publish FROM shown
UNION ALL SELECT 'second', kind, lesson, exp_num, CASE WHEN lesson IN ('en', 'fr') THEN 2 * value ELSE value END, CASE WHEN lesson IN ('en', 'fr') THEN 2 ELSE 1 END FROM shown
UNION ALL SELECT 'third', kind, lesson, exp_num, CASE WHEN lesson = 'fr' THEN 2 * value ELSE value END, CASE WHEN lesson = 'fr' THEN 2 ELSE 1 END FROM shown WHERE lesson <> 'en'"""


@query("store_versions", o.with_(o.RAW, o.EXPECT, MODELS, _SHOWN) + _READERS)
def store_versions(spark, sf_dir):
    """Three readers of one store: before and after two lessons are published again,
    and after one is removed. The first keeps its version although the second publish
    is complete when it reads; data of an unfinished publish is seen by none."""
    root = fresh_path(spark, "store")
    schema = "exp_num string, value bigint, publish int"

    def shown(factor, publish):
        models = _counted_models(spark, sf_dir, 1).withColumn("value", F.col("n") * factor)
        configs = b.expectations(spark, sf_dir).select(F.lit(fixed.ARCH_REGRESSION).alias("arch"), "lesson", "exp_num", (F.length("ideal") * factor).cast("bigint").alias("value"))
        return {k: t.select("arch", "lesson", "exp_num", "value", F.lit(publish).alias("publish")) for k, t in (("models", models), ("configs", configs))}

    versions.publish(shown(1, 1), root)
    pins = {"first": versions.pinned(spark, root)}
    again = {k: t.filter(F.col("lesson").isin("en", "fr")) for k, t in shown(2, 2).items()}
    versions.publish(again, root)
    versions.write_data(shown(3, 3), root, versions.new_version())
    pins["second"] = versions.pinned(spark, root)
    versions.remove(again["models"].filter("lesson = 'en'"), root)
    pins["third"] = versions.pinned(spark, root)
    out = None
    for reader, pin in pins.items():
        for kind in ("models", "configs"):
            rows = versions.load(pin, root, kind, schema).select(
                F.lit(reader).alias("reader"), F.lit(kind).alias("kind"), "lesson", "exp_num", "value", "publish")
            out = rows if out is None else out.unionByName(rows)
    return out


@query("lesson_export", o.with_(o.RAW, o.EXPECT) + "SELECT r.lesson, r.exp_num, count(*) AS n, sum(length(r.text)) AS chars, max(md5(e.ideal)) AS ideal "
       "FROM raw r JOIN expect e USING (lesson, exp_num) GROUP BY ALL")
def lesson_export(spark, sf_dir):
    data, configs = fresh_path(spark, "export-data"), fresh_path(spark, "export-config")
    training_csv.write_training(b.raw_training(spark, sf_dir).select("lesson", "exp_num", "text", "label"), data, ["lesson"])
    lesson_config.config_json(b.expectations(spark, sf_dir)).write.partitionBy("lesson").text(configs)
    rows = spark.read.schema("exp_num string, text string, label string, lesson string").options(
        **training_csv.CSV_OPTIONS, multiLine="true").csv(data)
    totals = rows.groupBy("lesson", "exp_num").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    ideals = lesson_config.explode_config(lesson_config.read_configs(spark, configs), ["lesson"])
    return totals.join(ideals.select("lesson", "exp_num", F.md5("ideal").alias("ideal")), ["lesson", "exp_num"])


@query("model_presence", o.with_(o.RAW) + "SELECT lesson, lesson IN (SELECT lesson FROM raw WHERE label = 'unsure') AS trained, n FROM "
       "(SELECT lang || CASE WHEN source IN ('src1', 'src2') THEN '-' || source ELSE '' END AS lesson, count(*) AS n FROM documents GROUP BY ALL)")
def model_presence(spark, sf_dir):
    """Which requested lessons have a stored model; some lessons do not exist."""
    name = F.concat("lang", F.when(F.col("source").isin("src1", "src2"), F.concat(F.lit("-"), "source")).otherwise(""))
    requested = b.table(spark, sf_dir, "documents").groupBy(name.alias("lesson")).agg(F.count(F.lit(1)).alias("n"))
    stored = b.raw_training(spark, sf_dir).filter("label = 'unsure'").select(F.lit("lr2").alias("arch"), "lesson")
    return model_store.presence(requested.withColumn("arch", F.lit("lr2")), stored).select("lesson", "trained", "n")


@query("model_removal", o.with_(o.RAW, MODELS) + "SELECT arch, lesson, exp_num, n, chars FROM models "
       "WHERE lesson NOT IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) < (SELECT count(*) / 8 FROM documents))")
def model_removal(spark, sf_dir):
    stored = _counted_models(spark, sf_dir, 1).drop("version")
    documents = b.table(spark, sf_dir, "documents")
    langs = documents.groupBy(F.col("lang").alias("lesson")).agg(F.count(F.lit(1)).alias("n"))
    small = langs.filter(F.col("n") < documents.count() / 8).select(F.lit("lr2").alias("arch"), "lesson")
    return model_store.without(stored, small)


@query("feature_write_back", o.with_(o.RAW, o.EXPECT) + "SELECT lesson, pos, exp_num, CASE WHEN lesson IN (SELECT lesson FROM raw WHERE label = 'unsure') "
       "THEN 'trained ' || exp_num ELSE array_to_string(good, ' ') END AS features FROM expect")
def feature_write_back(spark, sf_dir):
    current = b.expectations(spark, sf_dir).select("lesson", "pos", "exp_num", F.array_join("good", " ").alias("features"))
    done = b.raw_training(spark, sf_dir).filter("label = 'unsure'").select("lesson").distinct()
    trained = current.join(done, "lesson", "left_semi").withColumn("features", F.concat(F.lit("trained "), "exp_num"))
    return model_store.write_back(current, trained, ["lesson", "pos"])
