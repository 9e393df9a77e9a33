"""Nearest neighbour within a radius, with blocks pruned by distances to pivots.

A few points of each group are pivots. A point lies in a block by its nearest
and second nearest pivot and by how far it is from them, so a block is a small
region, or a run of regions with few points. Per block the least and greatest distance to every pivot is kept.
By the triangle inequality two points within the radius have distances to any
pivot that differ by no more than the radius. So two blocks whose ranges are further
apart for one pivot hold no such pair, and that is known from the ranges alone:
vectors are sent to the block pairs that are left. A task compares two blocks
with one matrix product and returns one neighbour per point, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.functions.vectors import norm
from markwise.operators.skew import salted_join
from markwise.session import written

PIVOTS = 16
BLOCK_ROWS = 2048
#: Steps that the range of distances is cut into to find block pairs.
STEPS = 64
#: Distances are sums of rounded numbers; ranges are widened by this share.
SLACK = 1e-9


def _distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def with_pivots(points: DataFrame, group: list[str], n_pivots: int = PIVOTS) -> DataFrame:
    """Adds ``far``, the distances to the group's pivots.

    Pivots are the points with the smallest hashes of their ids: spread like
    the points, and the same in every run. Each task sends its smallest ones only.
    """
    smallest = F.slice(F.array_sort(F.collect_list(F.struct("hash", "vector"))), 1, n_pivots)
    hashed = points.select(*group, F.xxhash64("id").alias("hash"), "vector")
    salt = F.pmod(F.col("hash"), F.lit(1024))
    # the least of each of 1024 parts of a group, then the least of those
    least = hashed.groupBy(*group, salt.alias("salt")).agg(F.min(F.struct("hash", "vector")).alias("l")).select(*group, "l.*")
    pivots = least.groupBy(*group).agg(smallest["vector"].alias("pivots"))
    joined = salted_join(points, pivots, group, "id", "inner")
    return joined.withColumn("far", F.transform("pivots", lambda p: _distance(F.col("vector"), p))).drop("pivots")


def blocked(points: DataFrame, group: list[str], radius: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Written: points of ``with_pivots`` with the block they lie in, a number per group."""
    ordered = F.array_sort(F.transform("far", lambda d, k: F.struct(d.alias("d"), k.alias("k"))))
    placed = points.withColumn("_o", ordered)
    ring = [F.floor(F.get("_o", F.lit(i))["d"] / radius).cast("long") for i in (0, 1)]
    region = [F.get("_o", F.lit(i))["k"] for i in (0, 1)] + ring
    names = ["_r0", "_r1", "_r2", "_r3"]
    placed = placed.withColumns(dict(zip(names, region, strict=True))).withColumn("cell", F.get("_o", F.lit(0))["k"]).drop("_o")
    placed = placed.withColumn("region", F.xxhash64(*names))
    sizes = placed.groupBy(*group, "region", *names).agg(F.count(F.lit(1)).alias("n"))
    # small regions next to each other share a block, or the pairs of blocks would be as many as those of points
    small = F.col("n") < block_rows
    before = Window.partitionBy(*group).orderBy(*names, "region").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.floor(F.sum(F.when(small, F.col("n")).otherwise(0)).over(before) / F.lit(block_rows))
    sizes = sizes.select(
        *group, "region", F.when(small, F.xxhash64(F.lit("run"), run)).otherwise(F.col("region")).alias("_block"),
        F.when(small, 1).otherwise(F.ceil(F.col("n") / F.lit(block_rows))).alias("parts"),
    )
    joined = salted_join(placed.drop(*names), sizes, [*group, "region"], "id", "inner")
    block = F.xxhash64("_block", F.pmod(F.xxhash64("id"), F.col("parts")))
    return written(joined.withColumn("block", block).drop("region", "parts", "_block"), "blocked")


def block_pairs(points: DataFrame, group: list[str], radius: float, n_pivots: int = PIVOTS) -> DataFrame:
    """Written (group…, one, other): blocks that can hold points within the radius of each other.

    Ranges of distances meet on steps of the distance to the first block's pivot; those that
    meet are compared for all pivots. Only ranges are moved here.
    """
    ranges = points.groupBy(*group, "block").agg(
        F.min("cell").alias("cell"),
        F.array(*[F.min(F.get("far", F.lit(k))) for k in range(n_pivots)]).alias("least"),
        F.array(*[F.max(F.get("far", F.lit(k))) for k in range(n_pivots)]).alias("most"),
    )
    ranges = written(ranges, "ranges")
    reach = radius * (1 + SLACK)
    top = ranges.agg(F.max(F.array_max("most"))).first()[0] or 0.0
    step = max(radius, top / STEPS)

    def steps(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / step).cast("int"), F.floor(high / step).cast("int"))

    own = [F.get(c, F.col("cell")) for c in ("least", "most")]
    ones = ranges.select(
        *group, F.col("block").alias("one"), F.col("least").alias("l1"), F.col("most").alias("m1"), F.col("cell").alias("pivot"),
        F.explode(steps(own[0] - reach, own[1] + reach)).alias("step"),
    )
    spans = F.transform("least", lambda low, k: F.struct(k.alias("pivot"), low.alias("low"), F.get("most", k).alias("high")))
    others = (
        ranges.select(*group, F.col("block").alias("other"), F.col("least").alias("l2"), F.col("most").alias("m2"), F.explode(spans).alias("s"))
        .filter("s.low IS NOT NULL")
        .select(*group, "other", "l2", "m2", F.col("s.pivot").alias("pivot"), F.explode(steps(F.col("s.low"), F.col("s.high"))).alias("step"))
    )
    apart = F.exists(
        F.arrays_zip(F.col("l1").alias("a"), F.col("m1").alias("b"), F.col("l2").alias("c"), F.col("m2").alias("d")),
        lambda r: F.coalesce((r["c"] - r["b"] > reach) | (r["a"] - r["d"] > reach), F.lit(False)),
    )
    met = ones.join(others, [*group, "pivot", "step"]).filter((F.col("one") <= F.col("other")) & ~apart)
    return written(met.select(*group, "one", "other").distinct(), "block_pairs")


def sent_points(points: DataFrame, pairs: DataFrame, group: list[str]) -> DataFrame:
    """Each point once per block pair of its block: (group…, one, other, side, id, vector)."""
    own = points.select(*group, "block", "id", "vector")
    parts = []
    for side, name in enumerate(("one", "other")):
        rows = pairs if side == 0 else pairs.filter("one <> other")
        near = own.withColumnRenamed("block", name).join(rows, [*group, name])
        parts.append(near.select(*group, "one", "other", F.lit(side).alias("side"), "id", "vector"))
    return parts[0].unionByName(parts[1])


def _nearest_of(group: list[str], radius: float):
    def closest(ids, own, other_ids, others, same):
        """Per point the exact nearest of the others within the radius, by (distance, id)."""
        squares = (own**2).sum(1)[:, None] + (others**2).sum(1)[None, :] - 2 * own @ others.T
        if same:
            np.fill_diagonal(squares, np.inf)
        found = []
        for i in np.flatnonzero(squares.min(1) <= radius**2 + 1e-9):
            near = np.flatnonzero(squares[i] <= squares[i].min() + 1e-9)
            exact = np.sqrt(((others[near] - own[i]) ** 2).sum(1))
            best = min(zip(exact.tolist(), other_ids[near].tolist(), strict=True))
            if best[0] <= radius:
                found.append((ids[i], *best))
        return found

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        a, a_ids = np.vstack(left["vector"]), left["id"].to_numpy()
        if right.empty:
            found = closest(a_ids, a, a_ids, a, True)
        else:
            c, c_ids = np.vstack(right["vector"]), right["id"].to_numpy()
            found = closest(a_ids, a, c_ids, c, False) + closest(c_ids, c, a_ids, a, False)
        made = pd.DataFrame(found, columns=["id", "distance", "neighbour"])
        for name in group:
            made[name] = frame[name].iloc[0]
        return made[[*group, "id", "distance", "neighbour"]]

    return run


def nearest_within(
    points: DataFrame, group: list[str], radius: float, block_rows: int = BLOCK_ROWS, n_pivots: int = PIVOTS
) -> DataFrame:
    """(group…, id, neighbour, distance): the nearest other point of the group, the
    smallest id of equally near ones; no row for points without one in the radius.

    ``points``: (group…, id bigint, vector array<double>). Equal vectors are
    one point with its two smallest ids, so copies cost nothing. Points without
    a vector are near nothing.
    """
    points = written(points.select(*group, "id", "vector").filter("vector IS NOT NULL"), "points")
    merged = points.groupBy(*group, "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    merged = written(merged, "merged")
    own = blocked(with_pivots(merged, group, n_pivots), group, radius, block_rows)
    pairs = block_pairs(own, group, radius, n_pivots)
    types = dict(points.dtypes)
    schema = ", ".join(f"{g} {types[g]}" for g in group) + ", id bigint, distance double, neighbour bigint"
    found = sent_points(own, pairs, group).groupBy(*group, "one", "other").applyInPandas(_nearest_of(group, radius), schema)
    best = found.groupBy(*group, "id").agg(F.min(F.struct("distance", "neighbour")).alias("n"))
    by_vector = merged.join(best, [*group, "id"], "left")
    # of copies, the nearest is the smallest id of the others
    second = salted_join(points, merged.filter("copies > 1").select(*group, "vector", F.col("id").alias("_first")), [*group, "vector"], "id", "inner")
    second = second.filter("id > _first").groupBy(*group, "vector").agg(F.min("id").alias("second"))
    told = by_vector.join(second, [*group, "vector"], "left").select(
        *group, "vector", F.col("id").alias("_first"), "copies", "second", F.col("n.neighbour").alias("near"), F.col("n.distance").alias("far")
    )
    rows = salted_join(points, told, [*group, "vector"], "id", "inner")
    copy = F.col("copies") > 1
    return rows.select(
        *group, "id",
        F.when(copy, F.when(F.col("id") == F.col("_first"), F.col("second")).otherwise(F.col("_first"))).otherwise(F.col("near")).alias("neighbour"),
        F.when(copy, F.lit(0.0)).otherwise(F.col("far")).alias("distance"),
    ).filter("neighbour IS NOT NULL")
