import numpy as np
from pyspark.sql import functions as F

from markwise.operators import nearest

SCHEMA = "g string, id bigint, vector array<double>"


def clustered(rng, n_clusters, size, width=64, spread=0.01):
    centres = rng.normal(size=(n_clusters, width))
    return np.concatenate([c + spread * rng.normal(size=(size, width)) for c in centres])


def brute(vectors, ids, radius):
    found = {}
    for i, v in zip(ids, vectors, strict=True):
        far = [(float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in zip(ids, vectors, strict=True) if j != i]
        best = min(far, default=(np.inf, None))
        if best[0] <= radius:
            found[i] = best
    return found


def test_nearest_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    groups = {
        "close": clustered(rng, 6, 25, 8, 0.1), "even": rng.uniform(size=(150, 2)), "one": rng.normal(size=(1, 8)),
        "copies": np.repeat(rng.normal(size=(9, 4)), [1, 2, 3, 1, 1, 5, 1, 2, 1], axis=0),
    }
    rows, want, at = [], {}, 0
    for name, vectors in groups.items():
        ids = rng.permutation(len(vectors)) + at
        at += len(vectors)
        rows += [(name, int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
        want |= brute(vectors, ids.tolist(), 0.3)
    points = spark.createDataFrame(rows, SCHEMA)
    got = nearest.nearest_within(points, ["g"], 0.3, block_rows=7, n_pivots=5).collect()
    assert {r.id: r.neighbour for r in got} == {i: j for i, (_, j) in want.items()}
    assert all(abs(r.distance - want[r.id][0]) < 1e-12 for r in got)
    assert nearest.nearest_within(points.limit(0), ["g"], 0.3).count() == 0


def test_clusters_are_sent_far_from_all_to_all(spark):
    vectors = clustered(np.random.default_rng(8), 50, 40)
    points = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    own = nearest.blocked(nearest.with_pivots(points, ["g"]), ["g"], 0.3, block_rows=40)
    n_blocks = own.select("block").distinct().count()
    pairs = nearest.block_pairs(own, ["g"], 0.3)
    sent = nearest.sent_points(own, pairs, ["g"]).count()
    assert n_blocks >= 50
    # all block pairs would send each point to about every block
    assert sent < 8 * len(vectors) < len(vectors) * n_blocks / 6
    assert pairs.filter(F.col("one") == F.col("other")).count() == n_blocks


def test_few_points_make_few_blocks(spark):
    rng = np.random.default_rng(3)
    made = rng.normal(size=(900, 24))
    made /= np.linalg.norm(made, axis=1)[:, None]
    points = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(made)], "g string, id bigint, vector array<double>")
    own = nearest.blocked(nearest.with_pivots(points, ["g"]), ["g"], 0.5, 200)
    sizes = [r["count"] for r in own.groupBy("block").count().collect()]
    assert sum(sizes) == 900 and len(sizes) <= 9 and max(sizes) <= 400
    got = {r.id: (r.neighbour, r.distance) for r in nearest.nearest_within(points, ["g"], 1.2, 200).collect()}
    far = np.sqrt(((made[:, None] - made[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    want = {i: (int(far[i].argmin()), far[i].min()) for i in range(900) if far[i].min() <= 1.2}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_points_without_a_vector_are_near_nothing(spark):
    rows = [("a", i, [float(i), 0.0]) for i in range(6)] + [("a", 9, None), ("b", 10, None)]
    got = nearest.nearest_within(spark.createDataFrame(rows, SCHEMA), ["g"], 1.5).collect()
    assert sorted(r.id for r in got) == list(range(6))
