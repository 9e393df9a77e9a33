"""Queries of clustering and pattern mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.functions import text
from markwise.operators import density, embedding, patterns, tournament, training_rows
from markwise.plans import bindings as b
from markwise.plans import oracle as o
from markwise.plans import training as t
from markwise.plans.catalog_training import TOKENS, inputs, stored_vocabulary
from markwise.plans.registry import query
from markwise.session import written

KEYS = ["lesson", "exp_num"]
GROUP = [*KEYS, "label"]
RADIUS = 1.3


@query("density_clusters", f"""WITH RECURSIVE near AS (
  SELECT a.label, a.vec_id AS p, b.vec_id AS q FROM embeddings a JOIN embeddings b ON a.label = b.label
  AND sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) ** 2))) <= {RADIUS}),
core AS (SELECT p FROM near GROUP BY p HAVING count(*) >= 5),
linked AS (SELECT label, p, q FROM near WHERE p IN (FROM core) AND q IN (FROM core)),
reach AS (SELECT label, p, p AS root FROM linked UNION SELECT l.label, l.q, r.root FROM reach r JOIN linked l USING (p)),
rooted AS (SELECT label, p, min(root) AS root FROM reach GROUP BY ALL),
bordered AS (SELECT n.label, n.p, min(r.root) AS root FROM near n JOIN rooted r ON n.q = r.p WHERE n.p NOT IN (FROM core) GROUP BY ALL),
numbers AS (SELECT label, root, row_number() OVER (PARTITION BY label ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT label, root FROM rooted))
SELECT e.label, e.vec_id, coalesce(n.cluster, -1) AS cluster FROM embeddings e
LEFT JOIN (FROM rooted UNION ALL FROM bordered) x ON e.vec_id = x.p LEFT JOIN numbers n ON x.label = n.label AND x.root = n.root""")
def density_clusters(spark, sf_dir):
    points = b.table(spark, sf_dir, "embeddings").select(
        "label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = density.density_clusters(points, ["label"], RADIUS)
    return found.select("label", F.col("id").alias("vec_id"), F.col("cluster").cast("bigint").alias("cluster"))


def _said(spark, sf_dir):
    training, expectations = inputs(spark, sf_dir)
    rows = written(t.training_set(training, expectations), "training")
    return written(t.sentences(rows), "said")


@query("answer_clusters")
def answer_clusters(spark, sf_dir):
    """Clusters of the training answers' mean vectors, at the service's radius."""
    clustered = t.cluster_sentences(_said(spark, sf_dir), stored_vocabulary(spark, sf_dir))
    return clustered.groupBy(*GROUP, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("sentence").alias("first"))


def _short_sentences(spark, sf_dir):
    """Documents and turns as sentences, by language or role."""
    docs = b.table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket"), F.lit(0).alias("place"), F.col("doc_id").alias("id"), "text")
    turns = b.table(spark, sf_dir, "conversations").select(
        F.col("role").alias("bucket"), F.lit(1).alias("place"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    both = docs.unionByName(turns)
    return written(both.select("bucket", "place", "id", text.preprocess("text").alias("tokens")), "short")


@query("cluster_representatives")
def cluster_representatives(spark, sf_dir):
    vocabulary = stored_vocabulary(spark, sf_dir)
    winners = tournament.representatives(
        _short_sentences(spark, sf_dir), vocabulary, ["bucket"], embedding.vector_width(vocabulary))
    return winners.select("bucket", "id", F.array_join("tokens", " ").alias("sentence"))


@query("archetype_emission", o.with_(o.RAW, o.EXPECT) + "SELECT lesson, exp_num, array_to_string(list_concat([array_to_string(i, ' ')], [array_to_string(q, ' ')]), ' | ') AS good, "
       f"array_to_string(q, ' ') AS bad FROM (SELECT lesson, exp_num, {o.tokens('ideal')} AS i, {o.tokens('question')} AS q FROM expect)")
def archetype_emission(spark, sf_dir):
    """Emission from given winners: ideal and question as clusters 0 and 1 of
    the good answers, the question as the bad answers' noise cluster."""
    e = b.expectations(spark, sf_dir).select(*KEYS, text.preprocess("ideal").alias("i"), text.preprocess("question").alias("q"))
    winners = e.select(*KEYS, F.inline(F.array(
        F.struct(F.lit("good").alias("label"), F.lit(1).alias("cluster"), F.col("q").alias("tokens")),
        F.struct(F.lit("good").alias("label"), F.lit(0).alias("cluster"), F.col("i").alias("tokens")),
        F.struct(F.lit("bad").alias("label"), F.lit(-1).alias("cluster"), F.col("q").alias("tokens")))))
    out = tournament.archetypes(winners, KEYS)
    return out.select(*KEYS, F.array_join("archetype_good", " | ").alias("good"), F.array_join("archetype_bad", " | ").alias("bad"))


def _winners(spark, sf_dir):
    """The ideal stands for the good answers, the question for the bad ones."""
    e = b.expectations(spark, sf_dir).select(*KEYS, text.preprocess("ideal").alias("i"), text.preprocess("question").alias("q"))
    return e.select(*KEYS, F.inline(F.array(
        F.struct(F.lit("good").alias("label"), F.col("i").alias("tokens")),
        F.struct(F.lit("bad").alias("label"), F.concat("q", F.array(F.lit("not"), F.lit("never"))).alias("tokens")))))


_MARK = f"CASE WHEN {o.negations('[w]')} > 0 THEN '[NEG]' ELSE w END"
CANDIDATES = f"""winners AS (
  SELECT lesson, exp_num, 'good' AS label, {o.tokens('ideal')} AS tokens FROM expect
  UNION ALL SELECT lesson, exp_num, 'bad', list_concat({o.tokens('question')}, ['not', 'never']) FROM expect),
words AS (SELECT DISTINCT lesson, exp_num, label, {_MARK} AS w FROM (SELECT lesson, exp_num, label, unnest(tokens) AS w FROM winners)),
candidates AS (
  SELECT lesson, exp_num, label, w AS pattern, [w] AS parts FROM words
  UNION ALL SELECT lesson, exp_num, label, a.w || ' + ' || b.w, [a.w, b.w] FROM words a JOIN words b USING (lesson, exp_num, label) WHERE a.w < b.w)"""


@query("pattern_candidates", o.with_(o.RAW, o.EXPECT, CANDIDATES) + "SELECT lesson, exp_num, label, pattern FROM candidates")
def pattern_candidates(spark, sf_dir):
    return patterns.candidate_patterns(_winners(spark, sf_dir))


SUPPORT = f"""{TOKENS},
marked AS (SELECT lesson, exp_num, CASE label WHEN 'good' THEN 1 ELSE 0 END AS y,
  list_distinct(CASE WHEN {o.negations('tokens')} > 0 THEN list_append(tokens, '[NEG]') ELSE tokens END) AS words FROM said),
sizes AS (SELECT lesson, exp_num, sum(y) AS n_good, sum(1 - y) AS n_bad FROM marked GROUP BY ALL),
support AS (SELECT c.lesson, c.exp_num, c.label, c.pattern, coalesce(sum(y) FILTER (list_has_all(m.words, c.parts)), 0) AS hits_good,
  coalesce(sum(1 - y) FILTER (list_has_all(m.words, c.parts)), 0) AS hits_bad
  FROM candidates c JOIN marked m USING (lesson, exp_num) GROUP BY ALL),
scored AS (SELECT *, 1 - CASE label WHEN 'good' THEN hits_good / n_bad ELSE hits_bad / n_good END AS score FROM support JOIN sizes USING (lesson, exp_num))"""
PATTERNS = o.with_(o.RAW, o.EXPECT, o.CLEAN, o.KEEP, o.ROWS, o.WHOLE, CANDIDATES, SUPPORT)


def _scored(spark, sf_dir):
    said = _said(spark, sf_dir)
    spoken = said.select(*KEYS, "sentence", training_rows.encode_label(F.col("label")).alias("y"), "tokens")
    sizes = spoken.groupBy(*KEYS).agg(F.sum("y").alias("n_good"), F.sum(1 - F.col("y")).alias("n_bad"))
    support = patterns.pattern_support(written(patterns.candidate_patterns(_winners(spark, sf_dir)), "candidates"), spoken)
    return written(patterns.pattern_scores(support, sizes), "scored")


@query("pattern_support", PATTERNS + "SELECT lesson, exp_num, label, pattern, hits_good, hits_bad, round(score, 6) AS score FROM scored")
def pattern_support(spark, sf_dir):
    return _scored(spark, sf_dir).select(*GROUP, "pattern", "hits_good", "hits_bad", F.round("score", 6).alias("score"))


KEPT = f""", passed AS (SELECT * FROM scored WHERE score > {fixed.PATTERN_CUTOFF}),
beaten AS (SELECT DISTINCT p.lesson, p.exp_num, p.label, p.pattern FROM passed p
  JOIN candidates c USING (lesson, exp_num, label, pattern) JOIN passed s ON s.lesson = p.lesson AND s.exp_num = p.exp_num AND s.label = p.label
  AND list_contains(c.parts, s.pattern) AND s.pattern < p.pattern AND s.score >= p.score),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lesson, exp_num, label ORDER BY score, pattern) AS k
  FROM passed ANTI JOIN beaten USING (lesson, exp_num, label, pattern)) WHERE k <= {fixed.PATTERN_TOP_N})"""


@query("pattern_deduplication", PATTERNS.rstrip() + KEPT + " SELECT lesson, exp_num, label, pattern, round(score, 6) AS score FROM kept")
def pattern_deduplication(spark, sf_dir):
    return patterns.deduplicate(_scored(spark, sf_dir)).select(*GROUP, "pattern", F.round("score", 6).alias("score"))


@query("pattern_selection", PATTERNS.rstrip() + KEPT + """, tested AS (SELECT *, (hits_good + hits_bad) AS h, n_good / (n_good + n_bad) AS s FROM kept),
ranked AS (SELECT *, CASE WHEN h > 0 THEN (hits_good - h * s) ** 2 / (h * s) + (hits_bad - h * (1 - s)) ** 2 / (h * (1 - s)) END AS chi2 FROM tested),
best AS (SELECT *, row_number() OVER (PARTITION BY lesson, exp_num, label ORDER BY round(chi2, 9) DESC NULLS LAST, pattern DESC) AS n,
  count(*) OVER (PARTITION BY lesson, exp_num, label) AS size FROM ranked)
SELECT lesson, exp_num, label, pattern FROM best WHERE n <= 10 OR size <= 10""")
def pattern_selection(spark, sf_dir):
    return patterns.select_best(patterns.deduplicate(_scored(spark, sf_dir))).select(*GROUP, "pattern")
