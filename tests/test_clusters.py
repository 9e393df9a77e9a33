import numpy as np
import pytest
from pyspark.sql import functions as F

from markwise.operators import density, tournament
from markwise.operators.assignment import alignment_score, unit_rows
from markwise.operators.components import connected_components
from markwise.operators.skew import rank_rows


def brute_dbscan(vectors, radius, min_samples):
    """Textbook sequential clustering on the full distance matrix."""
    n = len(vectors)
    near = [np.flatnonzero(np.sqrt(((vectors - v) ** 2).sum(1)) <= radius) for v in vectors]
    core = [len(x) >= min_samples for x in near]
    label = [-1] * n
    current = 0
    for i in range(n):
        if label[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            p = stack.pop()
            if label[p] == -1:
                label[p] = current
                if core[p]:
                    stack.extend(q for q in near[p] if label[q] == -1)
        current += 1
    return label


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_density_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    rows, expected = [], {}
    for name, n, spread in [("a", 90, 0.25), ("b", 60, 0.6), ("c", 3, 1.0)]:
        centres = rng.normal(size=(4, 3))
        vectors = centres[rng.integers(0, 4, n)] + rng.normal(size=(n, 3)) * spread
        vectors[n // 2 :: 5] = vectors[0]  # a group of copies
        expected[name] = brute_dbscan(vectors, 0.4, 5)
        rows += [(name, i, vectors[i].tolist()) for i in range(n)]
    points = spark.createDataFrame(rows, "g string, id bigint, vector array<double>")
    found = {}
    for r in density.density_clusters(points, ["g"], 0.4, 5, block_rows).collect():
        found.setdefault(r.g, {})[r.id] = r.cluster
    for name, labels in expected.items():
        assert [found[name][i] for i in range(len(labels))] == labels


def test_dense_points_are_settled_by_pivots_and_not_compared(spark):
    rng = np.random.default_rng(8)
    centres = np.array([[0.0, 0, 0], [0.9, 0, 0], [5, 5, 5]])
    vectors = np.concatenate(
        [centre + rng.normal(size=(n, 3)) * 0.08 for centre, n in zip(centres, (1500, 400, 200))]
        + [[[x, 0, 0] for x in np.linspace(0.2, 0.7, 9)], rng.uniform(-1.5, 1.5, size=(60, 3)), centres + 0.3]
    )
    rows = [("g", i, v.tolist()) for i, v in enumerate(rng.permutation(vectors))] + [("few", i, [float(i), 0.0, 0.0]) for i in range(3)]
    points = spark.createDataFrame(rows, "g string, id bigint, vector array<double>")
    found = {(r.g, r.id): r.cluster for r in density.density_clusters(points, ["g"], 0.4, 5, 100).collect()}
    expected = brute_dbscan(np.array([v for g, _, v in rows if g == "g"]), 0.4, 5)
    assert [found["g", i] for i in range(len(expected))] == expected
    assert [found["few", i] for i in range(3)] == [-1] * 3

    settled = density._settled(density._merged(points, ["g"]), ["g"], 0.4, 5)
    assert settled.filter("part IS NOT NULL").count() > 2000
    blocked, pairs = density._open_blocks(settled, ["g"], 0.4, 100)
    sizes = {r.block: r["count"] for r in blocked.groupBy("block").count().collect()}
    compared = sum(sizes[r.one] * sizes[r.other] for r in pairs.collect())
    assert compared < len(vectors) ** 2 / 4  # all pairs of these near cells were, before


def test_components_on_a_long_path(spark):
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(60)] + [("g", 100, 101)], "g string, a bigint, b bigint")
    nodes = spark.createDataFrame([("g", i) for i in [*range(61), 100, 101, 200]], "g string, id bigint")
    roots = {r.id: r.root for r in connected_components(nodes, edges, ["g"]).collect()}
    assert {roots[i] for i in range(61)} == {0}
    assert (roots[100], roots[101], roots[200]) == (100, 100, 200)


def test_rank_rows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.hash("id")).alias("v"), "id")
    got = rank_rows(df, ["k"], ["v", "id"]).toPandas()
    for _, part in got.groupby("k"):
        part = part.sort_values(["v", "id"])
        assert part["rank"].tolist() == list(range(len(part)))


def pair_scores(sentences, vector):
    """For each pair of sentences, the share that the pair adds to both of them."""
    width = len(next(iter(vector.values())))
    known = [[w for w in set(s) if w in vector] for s in sentences]
    units = [unit_rows(np.array([vector[w] for w in words]).reshape(-1, width)) for words in known]
    places = [{w: k for k, w in enumerate(words)} for words in known]
    shares = np.zeros((len(sentences), len(sentences)))
    for i, j in np.ndindex(shares.shape):
        if sentences[i] != sentences[j]:
            aligned = alignment_score(set(sentences[i]), set(sentences[j]), places[i], units[i], places[j], units[j])
            # the direction in which i answers j weighs by i's part of the pair's words
            shares[i, j] = aligned * len(sentences[i]) / (len(sentences[i]) + len(sentences[j]))
    return shares + shares.T


def elected(ids, shares):
    """The id that a tree of tens, each sending its most central member up, ends at."""
    if len(ids) == 1:
        return ids[0]
    tens = np.array_split(ids, range(10, len(ids), 10))
    return elected([ten[np.argmax(shares[np.ix_(ten, ten)].sum(1).round(9))] for ten in tens], shares)


def brute_winner(sentences, vector):
    short = [s for s in sentences if len(s) < 20]
    if len(short) < 5:
        return None
    return short[elected(list(range(len(short))), pair_scores(short, vector))]


def test_tournament_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    vector = {w: rng.normal(size=5).astype(np.float32).tolist() for w in words[:20]}
    vocabulary = spark.createDataFrame([(w, v) for w, v in vector.items()], "word string, vector array<float>")
    rows, clusters = [], {}
    for cluster, n in [("x", 37), ("y", 6), ("z", 4)]:
        for i in range(n):
            tokens = rng.choice(words, size=rng.integers(1, 23)).tolist()
            rows.append((cluster, 1, i, tokens))
            clusters.setdefault(cluster, []).append(tokens)
    sentences = spark.createDataFrame(rows, "c string, place int, id bigint, tokens array<string>")
    got = {r.c: r.tokens for r in tournament.representatives(sentences, vocabulary, ["c"], 5).collect()}
    expected = {c: brute_winner(s, vector) for c, s in clusters.items()}
    assert got == {c: w for c, w in expected.items() if w is not None}


def test_points_find_their_cluster_without_their_vectors(spark):
    """Copies, repeated ids, nulls in a vector and null vectors; vectors are not sent to be compared."""
    rows = [("g", i, [0.1 * (i % 3), 0.0]) for i in range(9)] + [("g", 3, [0.0, 0.0]), ("g", 20, [None, 9.0]), ("g", 21, [9.0, None]), ("g", 22, None)]
    points = spark.createDataFrame(rows, "g string, id bigint, vector array<double>")
    found = density.density_clusters(points, ["g"], 0.4, 5)
    got = sorted((r.id, r.cluster) for r in found.collect())
    assert got == sorted([(i, 0) for i in range(9)] + [(3, 0), (20, -1), (21, -1)])
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("vector#" in line for line in joins)
    assert "strategy=merge" in joins[0]
