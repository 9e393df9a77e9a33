"""Exact density clustering (DBSCAN) of vectors within groups.

Equal vectors are merged first and carry their number as weight. The others
are laid on a grid of two fixed projections whose cells are one radius wide,
so neighbours are in the same or an adjoining cell. A full cell is cut into
blocks; each task compares two blocks with one matrix product and returns
sums per point and a spanning forest, never the pairs themselves.

Clusters need no pairs where points lie dense. A pivot is a point that has enough
neighbours within some distance, counted in a bounded sample; by the triangle
inequality a point that is no further from it than the radius less that
distance has them all as neighbours. So it is a core point and hangs together
with the pivot: it is settled. Settled points that see several pivots join
these into parts. Blocks are compared only where one of them is not settled or
where they lie in different parts, and only if their distances to the group's first
pivot allow neighbours. The sample decides what is compared, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators.components import connected_components
from markwise.operators.embedding import vector_width
from markwise.operators.skew import salted_join
from markwise.session import written

BLOCK_ROWS = 1024
#: Points of a group that pivots are chosen from (twice as many at most, on average), and pivots.
SAMPLE_ROWS, PIVOTS = 1024, 256
#: Points that are compared with the pivots at a time.
CHUNK_ROWS = 8192
#: Rows of a block where points are not settled, and rings of a radius' width.
OPEN_ROWS, RINGS = 2048, 16
#: Distances by matrix products lose digits: a point this near to a limit is not settled.
SLACK = 1e-6
#: From a cell to itself and to half of the cells around it.
STEPS = (
    "CAST(array(struct(0L, 0L), struct(0L, 1L), struct(1L, -1L), struct(1L, 0L), struct(1L, 1L))"
    " AS array<struct<dx: bigint, dy: bigint>>)"
)
CODE = ["_code", "_check"]
TILE = ["hx", "hy", "nx", "ny", "left_block", "right_block"]


def _directions(width: int) -> np.ndarray:
    """What the vectors are projected on for the two axes of the grid."""
    rng = np.random.default_rng(20)
    found = [rng.normal(size=width) for _ in range(2)]
    return np.stack([direction / np.linalg.norm(direction) for direction in found])


def _cells(vectors: np.ndarray, radius: float) -> np.ndarray:
    """The grid's cells of vectors, a row each; they need not be those of ``_projections`` to the last digit."""
    places = np.floor(vectors @ _directions(vectors.shape[1]).T / (radius * (1 + 1e-9)))
    return np.nan_to_num(places, nan=0, posinf=0, neginf=0).astype(np.int64)


def _projections(points: DataFrame, radius: float) -> DataFrame:
    cells = []
    for axis, direction in zip(("cx", "cy"), _directions(vector_width(points)), strict=True):
        numbers = ", ".join(f"CAST({value!r} AS double)" for value in direction.tolist())
        projected = f"aggregate(zip_with(vector, array({numbers}), (a, b) -> a * b), 0D, (s, v) -> s + v)"
        # a hair wider than the radius, so rounding cannot part neighbours
        cells.append(F.expr(f"CAST(floor({projected} / {radius * (1 + 1e-9)!r}) AS bigint)").alias(axis))
    return points.select("*", *cells)


def tiles(points: DataFrame, group: list[str], radius: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each point once per (tile, side) it has to be compared in.

    A tile is a pair of blocks: two of one cell, or one of a cell and one of
    a cell next to it (half of the directions, so every pair meets once).
    """
    gridded = _projections(points, radius)
    sizes = gridded.groupBy(*group, "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks"))
    sizes = written(sizes, "cells")
    placed = salted_join(gridded, sizes, [*group, "cx", "cy"], "id", "inner")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    # every cell pair (home, next) that both exist, with both block counts
    steps = F.expr(STEPS)
    homes = sizes.select(*group, F.col("cx").alias("hx"), F.col("cy").alias("hy"), F.col("blocks").alias("h_blocks"), F.inline(steps))
    nexts = sizes.select(*group, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("blocks").alias("n_blocks"))
    pairs = (
        homes.withColumn("nx", F.col("hx") + F.col("dx"))
        .withColumn("ny", F.col("hy") + F.col("dy"))
        .join(nexts, [*group, "nx", "ny"])
        .withColumn("same", (F.col("dx") == 0) & (F.col("dy") == 0))
        .select(*group, "hx", "hy", "nx", "ny", "h_blocks", "n_blocks", "same")
    )
    pairs = written(pairs, "cell_pairs")
    keep = [*group, "id", "weight", "vector"] + (["core"] if "core" in points.columns else [])
    lefts = salted_join(
        placed.withColumnsRenamed({"cx": "hx", "cy": "hy"}), pairs, [*group, "hx", "hy"], "id", "inner"
    ).select(
        *keep, "hx", "hy", "nx", "ny", "same", F.col("block").alias("left_block"),
        F.explode(
            F.sequence(F.when(F.col("same"), F.col("block")).otherwise(F.lit(0).cast("bigint")), F.col("n_blocks") - 1)
        ).alias("right_block"),
        F.lit(0).alias("side"),
    )
    rights = salted_join(
        placed.withColumnsRenamed({"cx": "nx", "cy": "ny"}), pairs, [*group, "nx", "ny"], "id", "inner"
    ).select(
        *keep, "hx", "hy", "nx", "ny", "same",
        F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.when(F.col("same"), F.col("block")).otherwise(F.col("h_blocks") - 1))
        ).alias("left_block"),
        F.col("block").alias("right_block"),
        F.lit(1).alias("side"),
    )
    # a block compared with itself needs its points on one side only
    rights = rights.filter("NOT (same AND left_block = right_block)")
    columns = [*group, *TILE, "side", *keep[len(group):]]
    return lefts.select(*columns).unionByName(rights.select(*columns))


def _within(left: np.ndarray, right: np.ndarray, radius: float) -> np.ndarray:
    squares = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * left @ right.T
    close = squares <= radius**2
    # the product loses digits: settle what is near the radius directly
    for i, j in zip(*np.nonzero(np.abs(squares - radius**2) < 1e-9)):
        close[i, j] = np.sqrt(((left[i] - right[j]) ** 2).sum()) <= radius
    return close


def _sides(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
    return (left, left, True) if right.empty else (left, right, False)


def _head(frame: pd.DataFrame, group: list[str], n: int) -> dict[str, np.ndarray]:
    return {name: np.full(n, frame[name].iloc[0], dtype=object) for name in group}


def _count_neighbours(group: list[str], radius: float):
    """Neighbours of the points that are not settled; without that column, of all."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(frame)
        if left.empty:
            return pd.DataFrame(columns=[*group, "id", "n"])
        close = _within(np.vstack(left["vector"]), np.vstack(right["vector"]), radius)
        parts = [(left, close @ right["weight"].to_numpy())]
        if not same:
            parts.append((right, close.T @ left["weight"].to_numpy()))
        if "settled" in frame:  # all of a block are or none
            parts = [(side, n) for side, n in parts if not side["settled"].iloc[0]]
        ids = np.concatenate([side["id"].to_numpy() for side, _ in parts])
        head = _head(frame, group, len(ids))
        return pd.DataFrame({**head, "id": ids, "n": np.concatenate([n for _, n in parts])})

    return run


def _forest(group: list[str], radius: float):
    """Links core points of a tile to the smallest core id they hang together
    with in the tile, and border points to one id per such part."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right, _ = _sides(frame)
        columns = [*group, "a", "b", "border"]
        if left.empty:
            return pd.DataFrame(columns=columns)
        close = _within(np.vstack(left["vector"]), np.vstack(right["vector"]), radius)
        left_id, right_id = left["id"].to_numpy(), right["id"].to_numpy()
        left_core, right_core = left["core"].to_numpy(), right["core"].to_numpy()
        linked = close & left_core[:, None] & right_core[None, :]
        big = np.iinfo(np.int64).max
        left_root = np.where(left_core, left_id, big)
        right_root = np.where(right_core, right_id, big)
        while True:
            by_left = np.where(linked, right_root[None, :], big).min(axis=1)
            new_left = np.minimum(left_root, by_left)
            new_right = np.minimum(right_root, np.where(linked, new_left[:, None], big).min(axis=0))
            if (new_left == left_root).all() and (new_right == right_root).all():
                break
            left_root, right_root = new_left, new_right
        found = []
        for ids, core, root in ((left_id, left_core, left_root), (right_id, right_core, right_root)):
            joined = core & (root != ids)
            found.append(np.stack([ids[joined], root[joined], np.zeros(joined.sum(), dtype=np.int64)], axis=1))
        for ids, border, roots, near in (
            (left_id, ~left_core, right_root, close & right_core[None, :]),
            (right_id, ~right_core, left_root, (close & left_core[:, None]).T),
        ):
            for i in np.flatnonzero(border & near.any(axis=1)):
                parts = np.unique(roots[near[i]])
                found.append(np.stack([np.full(len(parts), ids[i]), parts, np.ones(len(parts), dtype=np.int64)], axis=1))
        links = np.unique(np.concatenate(found), axis=0)
        head = _head(frame, group, len(links))
        parts = {name: np.ascontiguousarray(links[:, k]) for k, name in enumerate(("a", "b", "border"))}
        return pd.DataFrame({**head, **parts}, columns=columns)

    return run


def _codes() -> list[Column]:
    """Two hashes of a vector that equal vectors share, with the places of its nulls, which hashes pass over."""
    nulls = F.transform("vector", lambda v: v.isNull())
    return [F.xxhash64(F.lit(k), "vector", nulls).alias(name) for k, name in enumerate(CODE)]


def _merged(points: DataFrame, group: list[str]) -> DataFrame:
    """One row per distinct vector: its smallest id and its number of copies."""
    return written(
        points.groupBy(*group, "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "merged"
    )


def _key_schema(df: DataFrame, group: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{name} {types[name]}" for name in group)


def _merged_counts(merged: DataFrame, group: list[str], radius: float, block_rows: int) -> DataFrame:
    return (
        tiles(merged, group, radius, block_rows)
        .groupBy(*group, *TILE)
        .applyInPandas(_count_neighbours(group, radius), f"{_key_schema(merged, group)}, id bigint, n bigint")
        .groupBy(*group, "id")
        .agg(F.sum("n").alias("n"))
    )


def neighbour_counts(points: DataFrame, group: list[str], radius: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group…, id, n): points of the group within ``radius``, itself included."""
    points = written(points.select(*group, "id", "vector"), "points")
    merged = _merged(points, group)
    counts = merged.join(_merged_counts(merged, group, radius, block_rows), [*group, "id"])
    return salted_join(points, counts.select(*group, "vector", "n"), [*group, "vector"], "id", "inner").select(
        *group, "id", "n"
    )


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    squares = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * left @ right.T
    return np.sqrt(np.maximum(squares, 0))


def _choose_pivots(group: list[str], radius: float, min_samples: int):
    """Points of the sample that settle others, those first that settle most. A group
    without any has its first point as a pivot that settles none."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order")
        vectors, weight = np.vstack(frame["vector"]), frame["weight"].to_numpy()
        apart = _distances(vectors, vectors)
        np.fill_diagonal(apart, 0)
        # weights are 1 or more, so the nearest few are enough
        few = np.argpartition(apart, min(min_samples, len(apart)) - 1, axis=1)[:, :min_samples]
        by_distance = np.take_along_axis(few, np.take_along_axis(apart, few, axis=1).argsort(axis=1), axis=1)
        enough = np.cumsum(weight[by_distance], axis=1) >= min_samples
        rows = np.arange(len(vectors))
        needed = apart[rows, by_distance[rows, enough.argmax(axis=1)]]
        reach = np.where(enough[:, -1], radius - needed, -np.inf) - SLACK
        covers = apart <= reach[:, None]
        missing, chosen = np.ones(len(vectors), bool), []
        while missing.any() and len(chosen) < PIVOTS:
            gain = (covers & missing).sum(axis=1)
            best = int(gain.argmax())
            if not gain[best]:
                break
            chosen.append(best)
            missing &= ~covers[best]
        chosen = chosen or [0]
        return pd.DataFrame(
            {**_head(frame, group, len(chosen)), "place": np.arange(len(chosen)), "pivot": list(vectors[chosen]), "reach": reach[chosen]}
        )

    return run


def _smallest_reached(linked: np.ndarray) -> np.ndarray:
    """The smallest place that each place of a symmetric matrix hangs together with."""
    root, last = np.arange(len(linked)), None
    linked = linked | np.eye(len(linked), dtype=bool)
    while last is None or (root != last).any():
        last, root = root, np.where(linked, root[None, :], len(linked)).min(axis=1)
    return root


def _settle(group: list[str], radius: float):
    """Per point its cell, its pivot, if one settles it, and its distance to the first;
    then rows that join pivots (``home`` and ``link``)."""
    columns = [*group, "id", "weight", "vector", "cx", "cy", "home", "far", "link"]

    def run(points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if points.empty or pivots.empty:
            return pd.DataFrame(columns=columns)
        pivots = pivots.sort_values("place")
        vectors, centres = np.vstack(points["vector"]), np.vstack(pivots["pivot"])
        apart = _distances(vectors, centres)
        within = apart <= pivots["reach"].to_numpy()[None, :]
        settled = within.any(axis=1) & points["id"].notna().to_numpy()
        home = np.where(within, apart, np.inf).argmin(axis=1)
        seen = ((apart <= radius - SLACK) & (pivots["reach"].to_numpy() >= 0)[None, :])[settled].astype(np.float32)
        joined = _smallest_reached(seen.T @ seen > 0)
        none = [None] * len(joined)
        cells = np.concatenate([_cells(vectors, radius), np.zeros((len(joined), 2), np.int64)])
        return pd.DataFrame(
            {
                **_head(points, group, len(points) + len(joined)),
                **{name: pd.Series([*points[name], *none], dtype=object) for name in ("id", "weight", "vector")},
                "cx": cells[:, 0],
                "cy": cells[:, 1],
                "home": np.concatenate([np.where(settled, home, -1), np.arange(len(joined))]),
                "far": np.concatenate([np.sqrt(((vectors - centres[0]) ** 2).sum(axis=1)), np.zeros(len(joined))]),
                "link": np.concatenate([np.full(len(points), -1), joined]),
            }
        )

    return run


def _join_parts(group: list[str]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        home, link = frame["home"].to_numpy(), frame["link"].to_numpy()
        linked = np.zeros((max(home.max(), link.max()) + 1,) * 2, bool)
        linked[home, link] = linked[link, home] = True
        joined = _smallest_reached(linked)
        return pd.DataFrame({**_head(frame, group, len(joined)), "home": np.arange(len(joined)), "joined": joined})

    return run


def _settled(merged: DataFrame, group: list[str], radius: float, min_samples: int) -> DataFrame:
    """Written (group…, id, weight, vector, cx, cy, far, part): part is the smallest id of
    the settled points that a point is known to hang together with, else null."""
    usable = merged.filter(F.expr("vector IS NOT NULL AND NOT exists(vector, v -> v IS NULL)"))
    for name in group:
        usable = usable.filter(F.col(name).isNotNull())
    schema, number = _key_schema(merged, group), F.xxhash64("id", "vector")
    n = F.count(F.lit(1))
    sizes = usable.groupBy(*group).agg(
        F.ceil(n / SAMPLE_ROWS).alias("_every"), F.ceil(n / CHUNK_ROWS).alias("_chunks"), F.min(number).alias("_first")
    )
    sizes = written(sizes, "sizes")
    dealt = salted_join(usable, sizes, group, ["id", "vector"], "inner").withColumn("order", number)
    # with the first point no group has an empty sample
    sample = dealt.filter((F.pmod("order", F.col("_every")) == 0) | (F.col("order") == F.col("_first"))).select(*group, "order", "weight", "vector")
    pivots = sample.groupBy(*group).applyInPandas(
        _choose_pivots(group, radius, min_samples), f"{schema}, place bigint, pivot array<double>, reach double"
    )
    pivots = written(pivots, "pivots")
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("order", F.lit("chunk")), F.col("_chunks")))
    sent = pivots.join(sizes, group).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)))
    placed = (
        dealt.select(*group, "_chunk", "id", "weight", "vector")
        .groupBy(*group, "_chunk")
        .cogroup(sent.groupBy(*group, "_chunk"))
        .applyInPandas(_settle(group, radius), f"{schema}, id bigint, weight bigint, vector array<double>, cx bigint, cy bigint, home bigint, far double, link bigint")
    )
    placed = written(placed, "placed")
    links = placed.filter("link >= 0").select(*group, "home", "link").distinct()
    joined = written(
        links.groupBy(*group).applyInPandas(_join_parts(group), f"{schema}, home bigint, joined bigint"), "joined"
    )
    points = placed.filter("link < 0").drop("link")
    firsts = points.filter("home >= 0").groupBy(*group, "home").agg(F.min("id").alias("id")).join(joined, [*group, "home"])
    parts = firsts.groupBy(*group, "joined").agg(F.min("id").alias("part"))
    parts = written(joined.join(parts, [*group, "joined"]).select(*group, "home", "part"), "parts")
    return written(salted_join(points, parts, [*group, "home"], ["id", "vector"], "left").drop("home"), "settled")


def _open_blocks(points: DataFrame, group: list[str], radius: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Written: points with the block they lie in, and the pairs of blocks (one, other)
    whose points have to be compared. Settled points go by the id of their part."""
    ring = F.floor(F.col("far") / (radius / RINGS)).alias("ring")
    gridded = points.select("*", ring, F.col("part").isNotNull().alias("settled"), F.coalesce("part", F.lit(0)).alias("kind"))
    place = [*group, "settled", "kind", "cx", "cy"]
    counted = gridded.groupBy(*place, "ring").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*place).orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    runs = counted.select(
        *place, "ring", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(block_rows)).alias("run"),
        F.ceil(F.col("n") / F.lit(block_rows)).alias("pieces"),
    )
    dealt = salted_join(gridded, written(runs, "runs"), [*place, "ring"], ["id", "vector"], "inner")
    piece = F.pmod(F.xxhash64("id", "vector"), F.col("pieces"))
    blocked = dealt.withColumn("block", F.xxhash64("settled", "kind", "cx", "cy", "run", piece))
    blocked = written(
        blocked.select(*place, "block", F.coalesce("part", "id").alias("id"), "weight", "vector", "far"), "blocked"
    )

    ranges = written(blocked.groupBy(*place, "block").agg(F.min("far").alias("low"), F.max("far").alias("high")), "ranges")
    steps = F.expr(STEPS)
    names = ["settled", "kind", "block", "low", "high"]
    homes = ranges.select(*group, "cx", "cy", F.struct(*names).alias("a"), F.inline(steps)).select(
        *group, "a", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), ((F.col("dx") == 0) & (F.col("dy") == 0)).alias("same"))
    nexts = ranges.select(*group, "cx", "cy", F.struct(*names).alias("b"))
    reach = radius * (1 + 1e-9) + 1e-9
    to_compare = (
        "(NOT same OR a.block <= b.block) AND NOT (a.settled AND b.settled AND a.kind = b.kind) "
        f"AND b.low - a.high <= {reach!r} AND a.low - b.high <= {reach!r}"
    )
    pairs = homes.join(nexts, [*group, "cx", "cy"]).filter(to_compare).select(
        *group, F.col("a.block").alias("one"), F.col("b.block").alias("other"), (F.col("a.settled") & F.col("b.settled")).alias("both_settled"))
    return blocked, written(pairs, "block_pairs")


def _sent(points: DataFrame, pairs: DataFrame, group: list[str]) -> DataFrame:
    """Each point once per pair of its block, grouped by pair; a block compared with
    itself needs its points on one side only."""
    keep = [c for c in points.columns if c not in (*group, "block")]
    parts = []
    for side, name in enumerate(("one", "other")):
        rows = pairs if side == 0 else pairs.filter("one <> other")
        near = points.withColumnRenamed("block", name).join(rows, [*group, name])
        parts.append(near.select(*group, "one", "other", F.lit(side).alias("side"), *keep))
    return parts[0].unionByName(parts[1]).groupBy(*group, "one", "other")


def density_clusters(
    points: DataFrame,
    group: list[str],
    radius: float = fixed.CLUSTER_RADIUS,
    min_samples: int = fixed.CLUSTER_MIN_SAMPLES,
    block_rows: int = OPEN_ROWS,
) -> DataFrame:
    """(group…, id, cluster): clusters numbered from 0 by their smallest core id.

    -1 is noise. A point that is near cores of several clusters belongs to the
    lowest numbered one. ``points``: (group…, id bigint, vector array<double>).
    """
    points = written(points.select(*group, "id", "vector", *_codes()), "points")
    merged = _merged(points, group)
    settled = _settled(merged, group, radius, min_samples)
    blocked, pairs = _open_blocks(settled, group, radius, block_rows)
    own = blocked.select(*group, "block", "settled", "id", "weight", "vector")
    counts = (
        _sent(own, pairs.filter("NOT both_settled").drop("both_settled"), group)
        .applyInPandas(_count_neighbours(group, radius), f"{_key_schema(merged, group)}, id bigint, n bigint")
        .groupBy(*group, "id")
        .agg(F.sum("n").alias("n"))
    )
    open_cores = counts.filter((F.col("n") >= min_samples) & F.col("id").isNotNull())
    open_cores = written(open_cores.select(*group, "id", F.lit(True).alias("_core")), "cores")
    core = F.col("settled") | F.coalesce("_core", F.lit(False))
    marked = salted_join(own, open_cores, [*group, "id"], "vector", "left").withColumn("core", core).drop("_core", "settled", "weight")
    links = written(
        _sent(marked, pairs.drop("both_settled"), group)
        .applyInPandas(_forest(group, radius), f"{_key_schema(merged, group)}, a bigint, b bigint, border bigint")
        .distinct(),
        "links",
    )
    parts = settled.filter("part IS NOT NULL").select(*group, "id", "part")
    cores = parts.select(*group, F.col("part").alias("id")).unionByName(open_cores.drop("_core")).distinct()
    found = connected_components(cores, links.filter("border = 0").select(*group, "a", "b"), group)
    borders = (
        links.filter("border = 1")
        .select(*group, F.col("a").alias("point"), F.col("b").alias("id"))
        .join(found, [*group, "id"])
        .groupBy(*group, "point")
        .agg(F.min("root").alias("root"))
        .withColumnRenamed("point", "id")
    )
    by_part = salted_join(parts, found.withColumnRenamed("id", "part"), [*group, "part"], "id", "inner").drop("part")
    roots = by_part.unionByName(found.join(open_cores, [*group, "id"], "left_semi"))
    # numbers run over the clusters of a group, not over its points
    order = Window.partitionBy(*group).orderBy("root")
    numbers = roots.select(*group, "root").distinct().withColumn("cluster", F.row_number().over(order) - 1)
    labelled = roots.unionByName(borders).join(numbers, [*group, "root"]).select(*group, "id", "cluster")
    labelled = written(labelled, "labelled")
    # vectors meet by 128 bits of their hashes, so they are not sent again; a row a
    # point is small as a file and large in a driver that broadcasts it
    codes = merged.select(*group, "id", *_codes())
    by_vector = codes.join(labelled.hint("merge"), [*group, "id"], "left").select(
        *group, *CODE, F.coalesce("cluster", F.lit(-1)).alias("cluster")
    ).hint("merge")
    points = points.filter("vector IS NOT NULL").select(*group, "id", *CODE)
    return salted_join(points, by_vector, [*group, *CODE], "id", "inner").select(*group, "id", "cluster")
