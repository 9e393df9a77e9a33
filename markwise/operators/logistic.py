"""One penalised, class-balanced logistic model per key, with leave-one-out accuracy.

Groups up to ``local_rows`` are each solved inside one task. Larger groups are
never gathered: Newton's sums are formed per partition, added up by key, and
only the small systems (one per key) are solved in tasks. Both ways reach the
same optimum, and the leave-one-out decisions are exact in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.operators import newton
from markwise.operators.skew import salted_join
from markwise.session import written

LOCAL_ROWS = 20_000
ROW = ["place", "row_id"]


def _key_schema(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{name} {types[name]}" for name in names)


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.vstack(column.to_numpy()).astype(np.float64)
    return np.hstack([x, np.ones((len(x), 1))])


def class_counts(features: DataFrame, keys: list[str]) -> DataFrame:
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("y").alias("n_good"),
    )


def fit_models(features: DataFrame, keys: list[str], local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(keys…, n_rows, coef, intercept, accuracy) for every key with both classes.

    ``features``: (keys…, place, row_id, y, x). Accuracy is null where
    some fold is left with a single class.
    """
    counts = written(class_counts(features, keys).filter("n_good > 0 AND n_good < n_rows"), "counts")
    small = counts.filter(F.col("n_rows") <= local_rows)
    models = _fit_small(features, small.select(*keys), keys)
    large = counts.filter(F.col("n_rows") > local_rows)
    if large.isEmpty():
        return models
    return models.unionByName(_fit_large(features, large, keys))


def _fit_small(features: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ROW)
        x, y = _matrix(group["x"]), group["y"].to_numpy(dtype=float)
        w_bad, w_good = newton.class_weights((y == 0).sum(), (y == 1).sum())
        beta = newton.fit(x, y, np.where(y == 1, w_good, w_bad))
        accuracy = newton.leave_one_out_hits(x, y) / len(y)
        return pd.DataFrame([[*key, len(y), beta[:-1].tolist(), beta[-1], accuracy]])

    schema = f"{_key_schema(features, keys)}, n_rows bigint, coef array<double>, intercept double, accuracy double"
    rows = salted_join(features.select(*keys, *ROW, "y", "x"), chosen, keys, "row_id", "left_semi")
    return rows.groupBy(*keys).applyInPandas(solve, schema)


# --- large groups ----------------------------------------------------------

_STATE = (
    "variant string, w_bad double, w_good double, out_x array<double>, out_y double, out_w double, "
    "trial array<double>, beta array<double>, loss double, step array<double>, scale double, "
    "hessian array<double>, done boolean"
)


_VARIANT = ["variant", "w_bad", "w_good", "trial"]
#: Variants that leave out the rows whose ``fold`` is the number behind this.
_FOLD = "fold:"


def _packed(state: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per key, each named column as an array over the key's variants."""
    together = state.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("all"))
    return together.select(*keys, *[F.col("all").getField(name).alias(name) for name in names])


def _partial_sums(keys: list[str]):
    """Per-partition Newton sums of every (key, variant) at its trial point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                x, y = _matrix(group["x"]), group["y"].to_numpy(dtype=float)
                first = group.iloc[0]
                for variant, w_bad, w_good, trial in zip(*[first[name] for name in _VARIANT]):
                    weight = np.where(y == 1, w_good, w_bad)
                    if variant.startswith(_FOLD):
                        weight = weight * (group["fold"].to_numpy() != int(variant[len(_FOLD) :]))
                    loss, gradient, hessian = newton.sums(x, y, weight, np.asarray(trial))
                    part = np.concatenate([[loss], gradient, hessian.ravel()])
                    totals[(*key, variant)] = totals.get((*key, variant), 0) + part
            if len(totals) > 10_000:
                yield _as_frame(totals, keys)
                totals = {}
        if totals:
            yield _as_frame(totals, keys)

    return run


def _as_frame(totals: dict[tuple, np.ndarray], keys: list[str]) -> pd.DataFrame:
    rows = [[*key, part.tolist()] for key, part in totals.items()]
    return pd.DataFrame(rows, columns=[*keys, "variant", "part"])


def _sums_at_trial(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    packed = _packed(state, keys, _VARIANT)
    joined = salted_join(rows, packed, keys, "row_id", "inner")
    folds = ["fold"] if "fold" in rows.columns else []
    parts = joined.select(*keys, "y", "x", *folds, *_VARIANT).mapInPandas(
        _partial_sums(keys), f"{_key_schema(rows, keys)}, variant string, part array<double>"
    )
    cells = parts.select(*keys, "variant", F.posexplode("part").alias("cell", "value"))
    summed = cells.groupBy(*keys, "variant", "cell").agg(F.sum("value").alias("value"))
    return summed.groupBy(*keys, "variant").agg(
        F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("cells")
    ).select(*keys, "variant", F.col("cells.value").alias("sums"))


def _advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One Newton step (or step halving) per row of the state."""
    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            sums, trial = np.asarray(row.pop("sums")), np.asarray(row["trial"])
            d = len(trial)
            loss, gradient, hessian = sums[0], sums[1 : d + 1], sums[d + 1 :].reshape(d, d)
            if row["out_x"] is not None:
                x, y = np.asarray(row["out_x"])[None, :], np.array([row["out_y"]])
                one = newton.sums(x, y, np.array([row["out_w"]]), trial)
                loss, gradient, hessian = loss - one[0], gradient - one[1], hessian - one[2]
            loss, gradient, hessian = newton.penalised(trial, loss, gradient, hessian)
            first = row["beta"] is None
            if first or loss <= row["loss"] + 1e-12 * abs(row["loss"]):
                step = np.linalg.solve(hessian, gradient)
                row.update(beta=trial, loss=loss, step=step, scale=1.0, hessian=hessian.ravel())
                row.update(trial=trial - step, done=newton.converged(loss, gradient, step))
            else:
                scale = row["scale"] / 2
                row.update(scale=scale, trial=np.asarray(row["beta"]) - scale * np.asarray(row["step"]))
                at_best = np.asarray(row["hessian"]).reshape(d, d) @ np.asarray(row["step"])
                row["done"] = newton.stalled(row["loss"], at_best, np.asarray(row["step"]), scale)
            out.append({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in row.items()})
        yield pd.DataFrame(out, columns=[c for c in batch.columns if c != "sums"])


def _minimise(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Runs Newton for every (key, variant) of ``state`` until all are done.

    The loop's length is the number of Newton steps, not a matter of the data
    size; each round is one pass over the rows of unfinished keys.
    """
    columns = state.columns
    finished = []
    for _ in range(newton.MAX_STEPS):
        sums = _sums_at_trial(rows, state, keys)
        schema = f"{_key_schema(rows, keys)}, {_STATE}"
        state = written(
            state.join(sums, [*keys, "variant"]).select(*columns, "sums").mapInPandas(_advance, schema), "newton"
        )
        finished.append(state.filter("done"))
        state = state.filter("NOT done")
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"no optimum within {newton.MAX_STEPS} evaluations")
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return result


def _fresh_state(counts: DataFrame, keys: list[str], width: DataFrame) -> DataFrame:
    def variant(name: str, less_bad: int, less_good: int):
        n_bad, n_good = F.col("n_rows") - F.col("n_good") - less_bad, F.col("n_good") - less_good
        n = n_bad + n_good
        return F.struct(
            F.lit(name).alias("variant"), F.try_divide(n, 2 * n_bad).alias("w_bad"), F.try_divide(n, 2 * n_good).alias("w_good")
        )

    variants = F.array(variant("all", 0, 0), variant("out0", 1, 0), variant("out1", 0, 1))
    return _from_zero(counts.join(width, keys).select(*keys, "d", F.inline(variants)), keys)


def _from_zero(variants: DataFrame, keys: list[str]) -> DataFrame:
    """The state in which Newton begins, of (keys…, d, variant, w_bad, w_good)."""
    return variants.filter("w_bad IS NOT NULL AND w_good IS NOT NULL").select(
        *keys, "variant", "w_bad", "w_good",
        F.lit(None).cast("array<double>").alias("out_x"), F.lit(None).cast("double").alias("out_y"),
        F.lit(None).cast("double").alias("out_w"),
        F.array_repeat(F.lit(0.0), F.col("d").cast("int")).alias("trial"),
        F.lit(None).cast("array<double>").alias("beta"), F.lit(None).cast("double").alias("loss"),
        F.lit(None).cast("array<double>").alias("step"), F.lit(1.0).alias("scale"),
        F.lit(None).cast("array<double>").alias("hessian"), F.lit(False).alias("done"),
    )


def _peaks(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, group in batch.groupby(keys, sort=False):
                x = _matrix(group["x"])
                first = group.iloc[0]
                for variant, beta, hessian in zip(first["variant"], first["beta"], first["hessian"]):
                    d = len(beta)
                    out.append([*key, variant, newton.leverages(x, np.asarray(hessian).reshape(d, d)).max()])
            yield pd.DataFrame(out, columns=[*keys, "variant", "peak"])

    return run


def _decisions(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, group in batch.groupby([*keys, "y"], sort=False):
                x, y = _matrix(group["x"]), group["y"].to_numpy(dtype=float)
                first = group.iloc[0]
                d = x.shape[1]
                margin, error = newton.without_one(
                    x, y, first["weight"], np.asarray(first["beta"]),
                    np.asarray(first["hessian"]).reshape(d, d), first["peak"],
                )
                sure = np.abs(margin) > error
                yield pd.DataFrame(
                    {
                        **{k: v for k, v in zip(keys, [[part] * len(group) for part in key])},
                        "place": group["place"].to_numpy(),
                        "row_id": group["row_id"].to_numpy(),
                        "y": group["y"].to_numpy(),
                        "hit": np.where(sure, (margin > 0).astype(int), 0),
                        "sure": sure,
                    }
                )

    return run


def _fit_large(features: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    rows = salted_join(features.select(*keys, *ROW, "y", "x"), counts.select(*keys), keys, "row_id", "left_semi")
    width = rows.groupBy(*keys).agg((F.max(F.size("x")) + 1).alias("d"))
    fitted = written(_minimise(rows, _fresh_state(counts, keys, width), keys), "fits")

    schema = _key_schema(rows, keys)
    parents = fitted.filter("variant <> 'all'").join(counts.filter("least(n_good, n_rows - n_good) >= 2"), keys)
    packed = _packed(parents, keys, ["variant", "beta", "hessian"])
    peaks = (
        salted_join(rows, packed, keys, "row_id", "inner")
        .select(*keys, "x", "variant", "beta", "hessian")
        .mapInPandas(_peaks(keys), f"{schema}, variant string, peak double")
        .groupBy(*keys, "variant")
        .agg(F.max("peak").alias("peak"))
    )
    own = parents.join(peaks, [*keys, "variant"]).select(
        *keys,
        F.when(F.col("variant") == "out1", 1).otherwise(0).alias("y"),
        "w_bad", "w_good", "beta", "hessian", "peak",
        F.when(F.col("variant") == "out1", F.col("w_good")).otherwise(F.col("w_bad")).alias("weight"),
    )
    own = written(own, "parents")
    decided = written(
        salted_join(rows, own.select(*keys, "y", "beta", "hessian", "peak", "weight"), [*keys, "y"], "row_id", "inner")
        .mapInPandas(_decisions(keys), f"{schema}, place int, row_id bigint, y int, hit int, sure boolean"),
        "folds",
    )
    hits = decided.groupBy(*keys).agg(F.sum("hit").alias("hits"))

    unsure = decided.filter("NOT sure").select(*keys, *ROW)
    if not unsure.isEmpty():
        folds = salted_join(rows, unsure, [*keys, *ROW], "row_id", "inner").join(own, [*keys, "y"])
        state = folds.select(
            *keys,
            F.concat_ws(":", *ROW).alias("variant"), "w_bad", "w_good",
            F.concat("x", F.array(F.lit(1.0))).alias("out_x"), F.col("y").cast("double").alias("out_y"),
            F.col("weight").alias("out_w"), F.col("beta").alias("trial"),
            F.lit(None).cast("array<double>").alias("beta"), F.lit(None).cast("double").alias("loss"),
            F.lit(None).cast("array<double>").alias("step"), F.lit(1.0).alias("scale"),
            F.lit(None).cast("array<double>").alias("hessian"), F.lit(False).alias("done"),
        )
        refits = written(_minimise(rows, written(state, "unsure"), keys), "refits")
        z = F.aggregate(F.zip_with("out_x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        more = refits.groupBy(*keys).agg(
            F.sum(((z > 0) == (F.col("out_y") == 1)).cast("int")).alias("more")
        )
        hits = hits.join(more, keys, "left").select(
            *keys, (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits")
        )
    n = F.size("beta")
    return (
        fitted.filter("variant = 'all'")
        .join(counts, keys)
        .join(hits, keys, "left")
        .select(
            *keys, "n_rows",
            F.slice("beta", F.lit(1), n - 1).alias("coef"),
            F.element_at("beta", -1).alias("intercept"),
            (F.col("hits") / F.col("n_rows")).alias("accuracy"),
        )
    )


# --- many fits of the same rows in one plan ---------------------------------


def replicated_fits(features: DataFrame, keys: list[str], factors: list[int]) -> DataFrame:
    """(keys…, factor, n_rows, coef, intercept): the models of every row repeated ``factor`` times.

    A row that is there r times pulls with r times its weight, and class balance
    stays as it is. So no row is copied: all factors are variants of one Newton
    plan that reads the rows once per step. Keys with one class have no model.
    """
    counts = written(class_counts(features, keys).filter("n_good > 0 AND n_good < n_rows"), "counts")
    rows = salted_join(features.select(*keys, *ROW, "y", "x"), counts.select(*keys), keys, "row_id", "left_semi")
    width = rows.groupBy(*keys).agg((F.max(F.size("x")) + 1).alias("d"))

    def variant(factor: int):
        bad = factor * F.col("n_rows") / (2 * (F.col("n_rows") - F.col("n_good")))
        good = factor * F.col("n_rows") / (2 * F.col("n_good"))
        return F.struct(F.lit(str(factor)).alias("variant"), bad.alias("w_bad"), good.alias("w_good"))

    variants = counts.join(width, keys).select(*keys, "d", F.inline(F.array(*[variant(f) for f in factors])))
    fitted = _minimise(rows, written(_from_zero(variants, keys), "state"), keys)
    n = F.size("beta")
    return fitted.join(counts, keys).select(
        *keys, F.col("variant").cast("int").alias("factor"), "n_rows",
        F.slice("beta", F.lit(1), n - 1).alias("coef"), F.element_at("beta", -1).alias("intercept"),
    )


def fold_of(folds: int, seed: int):
    """The fold of a row, by its identity alone: the same however the rows lie."""
    return F.pmod(F.xxhash64(F.lit(seed), *ROW), F.lit(folds)).cast("int")


def k_fold_hits(features: DataFrame, keys: list[str], folds: int = 10, seed: int = 0) -> DataFrame:
    """(keys…, n_rows, hits): rows that the model of the other folds gets right.

    Class weights are those of the other folds. All folds are variants of one
    Newton plan: a step reads every row once and adds it to the sums of all folds
    but its own. ``hits`` is null where the rows outside some fold have one class only.
    Unlike leaving out one row, the number depends on the seed.
    """
    marked = written(features.select(*keys, *ROW, "y", "x").withColumn("fold", fold_of(folds, seed)), "folds")
    totals = class_counts(marked, keys)
    own = marked.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("out_rows"), F.sum("y").alias("out_good"))
    width = marked.groupBy(*keys).agg((F.max(F.size("x")) + 1).alias("d"))
    n, good = F.col("n_rows") - F.col("out_rows"), F.col("n_good") - F.col("out_good")
    variants = own.join(totals, keys).join(width, keys).select(
        *keys, "d", F.concat(F.lit(_FOLD), "fold").alias("variant"),
        F.try_divide(n, 2 * (n - good)).alias("w_bad"), F.try_divide(n, 2 * good).alias("w_good"),
    )
    variants = written(variants, "variants")
    one_class = variants.filter("w_bad IS NULL OR w_good IS NULL").select(*keys).distinct().withColumn("_broken", F.lit(True))
    state = written(_from_zero(variants.join(one_class, keys, "left_anti"), keys), "state")
    wanted = totals.select(*keys, "n_rows").join(one_class, keys, "left")
    if state.isEmpty():
        return wanted.select(*keys, "n_rows", F.lit(None).cast("bigint").alias("hits"))
    fitted = _minimise(marked, state, keys).select(
        *keys, F.substring("variant", len(_FOLD) + 1, 10).cast("int").alias("fold"), "beta"
    )
    joined = salted_join(marked, fitted, [*keys, "fold"], "row_id", "inner")
    z = F.aggregate(
        F.zip_with(F.concat("x", F.array(F.lit(1.0))), "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    hits = joined.groupBy(*keys).agg(F.sum(((z > 0) == (F.col("y") == 1)).cast("bigint")).alias("hits"))
    return wanted.join(hits, keys, "left").select(*keys, "n_rows", "hits")
