import numpy as np
import pytest
from pyspark.sql import functions as F

from markwise.operators import evaluation, logistic, newton


def _frame(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for exp, n, d in [("0", 60, 4), ("1", 200, 6)]:
        x = rng.normal(size=(n, d))
        y = (x[:, 0] + rng.normal(size=n) > 0.3).astype(int)
        rows += [("en", exp, 1, i, int(y[i]), x[i].tolist()) for i in range(n)]
        full = np.hstack([x, np.ones((n, 1))])
        w_bad, w_good = newton.class_weights((y == 0).sum(), y.sum())
        beta = newton.fit(full, y.astype(float), np.where(y == 1, w_good, w_bad))
        truth[exp] = (beta, newton.leave_one_out_hits(full, y.astype(float)) / n)
    rows += [("en", "2", 1, i, 1, [float(i)]) for i in range(12)]
    rows += [("en", "3", 1, i, int(i > 0), [float(i % 3)]) for i in range(12)]
    schema = "lesson string, exp_num string, place int, row_id bigint, y int, x array<double>"
    return spark.createDataFrame(rows, schema), truth


@pytest.mark.parametrize("local_rows", [4096, 100, 0])
def test_both_ways_give_the_same_models(spark, local_rows):
    features, truth = _frame(spark)
    models = {r.exp_num: r for r in logistic.fit_models(features, ["lesson", "exp_num"], local_rows).collect()}
    assert set(models) == {"0", "1", "3"}  # "2" has one class only
    for exp, (beta, accuracy) in truth.items():
        assert np.allclose([*models[exp].coef, models[exp].intercept], beta, atol=1e-6)
        assert models[exp].accuracy == accuracy
    assert models["3"].accuracy is None


KEYS = ["lesson", "exp_num"]


def test_weights_stand_for_copies(spark):
    features, _ = _frame(spark)
    factors = [1, 2, 4, 8]
    fits = {(r.exp_num, r.factor): r for r in logistic.replicated_fits(features, KEYS, factors).collect()}
    assert set(fits) == {(e, f) for e in "013" for f in factors}
    for factor in (2, 8):
        copies = evaluation.replicate(features, factor).withColumn("row_id", F.col("row_id") * factor + F.col("copy")).drop("copy")
        for row in logistic.fit_models(copies, KEYS).collect():
            found = fits[row.exp_num, factor]
            assert np.allclose([*found.coef, found.intercept], [*row.coef, row.intercept], atol=1e-6)
    rows = evaluation.replication_experiment(features, KEYS, factors).collect()
    for exp in "013":
        own = sorted((r for r in rows if r.exp_num == exp), key=lambda r: r.factor)
        assert [r.n_rows for r in own] == [f * own[0].n_rows for f in factors]
        assert all(b.loss <= a.loss + 1e-12 and b.confidence >= a.confidence - 1e-12 for a, b in zip(own, own[1:], strict=False))
    data = features.filter("exp_num = '0'").toPandas()
    x, y = np.hstack([np.vstack(data.x), np.ones((len(data), 1))]), data.y.to_numpy(float)
    beta = np.array([*fits["0", 4].coef, fits["0", 4].intercept])
    z = x @ beta
    (got,) = [r for r in rows if (r.exp_num, r.factor) == ("0", 4)]
    assert got.accuracy == pytest.approx(((z > 0) == (y == 1)).mean())
    assert got.confidence == pytest.approx(newton.sigmoid(np.abs(z)).mean())


@pytest.mark.parametrize("folds, seed", [(5, 0), (3, 7)])
def test_folds_are_fitted_without_their_rows(spark, folds, seed):
    features, _ = _frame(spark)
    got = {r.exp_num: r for r in logistic.k_fold_hits(features, KEYS, folds, seed).collect()}
    told = features.withColumn("fold", logistic.fold_of(folds, seed)).toPandas()
    for exp in "01":
        data = told[told.exp_num == exp]
        x, y = np.hstack([np.vstack(data.x), np.ones((len(data), 1))]), data.y.to_numpy(float)
        hits = 0
        for fold in range(folds):
            out = (data.fold == fold).to_numpy()
            w_bad, w_good = newton.class_weights((y[~out] == 0).sum(), (y[~out] == 1).sum())
            beta = newton.fit(x[~out], y[~out], np.where(y[~out] == 1, w_good, w_bad))
            hits += int(((x[out] @ beta > 0) == (y[out] == 1)).sum())
        assert got[exp].hits == hits and got[exp].n_rows == len(y)
    # one class only, and one row of a class: some fold cannot be fitted
    assert got["2"].hits is None and got["3"].hits is None


def test_a_search_that_stands_still_is_an_error():
    gradient = np.array([1.0, 0.0])
    assert not newton.stalled(1.0, gradient, gradient, 0.5)
    assert newton.stalled(1.0, gradient, np.array([1e-13, 0.0]), 1e-7)
    with pytest.raises(RuntimeError):
        newton.stalled(1.0, gradient, gradient, 1e-7)
