import itertools

import numpy as np
import pytest

from markwise.operators import newton
from markwise.operators import assignment
from markwise.operators.assignment import alignment_score, best_assignment, priced_assignment


@pytest.mark.parametrize("rows, columns", [(1, 4), (2, 2), (3, 5), (5, 3), (6, 6), (4, 7)])
def test_assignment_against_all_permutations(rows, columns):
    rng = np.random.default_rng(rows * 10 + columns)
    for trial in range(60):
        weight = rng.normal(size=(rows, columns)).round(trial % 3)
        weight[rng.random(weight.shape) < 0.3] = 0
        small, large = sorted(weight.shape)
        by_row = weight if weight.shape[0] == small else weight.T
        brute = max(
            sum(by_row[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small)
        )
        assert best_assignment(weight) == pytest.approx(brute, abs=1e-9)


def test_alignment_edge_cases():
    none = np.zeros((0, 3))
    assert alignment_score({"a"}, {"a"}, {}, none, {}, none) == 1.0
    assert alignment_score(set(), {"a"}, {}, none, {}, none) == 0.0
    assert alignment_score({"a"}, {"a", "b"}, {}, none, {}, none) == 0.5
    units = np.eye(3)
    # b is known and best left with c; the unknown x takes what is left
    assert alignment_score({"b", "x"}, {"c", "d"}, {"b": 0}, units[:1], {"c": 0, "d": 1}, units[:2]) == 0.5
    # forced pair with a negative similarity
    assert alignment_score({"b"}, {"c"}, {"b": 0}, units[:1], {"c": 0}, -units[:1]) == -1.0


def _brute_hits(x, y):
    hits = 0
    for i in range(len(y)):
        keep = np.arange(len(y)) != i
        w_bad, w_good = newton.class_weights((y[keep] == 0).sum(), (y[keep] == 1).sum())
        beta = newton.fit(x[keep], y[keep], np.where(y[keep] == 1, w_good, w_bad))
        hits += int((x[i] @ beta > 0) == (y[i] == 1))
    return hits


@pytest.mark.parametrize("n, d, seed", [(12, 3, 0), (40, 5, 1), (60, 8, 2), (150, 6, 3), (30, 20, 4)])
def test_leave_one_out_is_exact(n, d, seed):
    rng = np.random.default_rng(seed)
    x = np.hstack([rng.normal(size=(n, d)) * rng.choice([0.3, 1, 4], size=d), np.ones((n, 1))])
    y = (x[:, 0] + rng.normal(size=n) > 0.4).astype(float)
    assert newton.leave_one_out_hits(x, y) == _brute_hits(x, y)


def test_margin_bound_holds():
    rng = np.random.default_rng(9)
    x = np.hstack([rng.normal(size=(80, 4)), np.ones((80, 1))])
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    w = np.ones(80)
    beta = newton.fit(x, y, w)
    hessian = newton.penalised(beta, *newton.sums(x, y, w, beta))[2]
    margin, error = newton.without_one(x, y, 1.0, beta, hessian, newton.leverages(x, hessian).max())
    assert np.isfinite(error).mean() > 0.5
    for i in range(80):
        out = w.copy()
        out[i] = 0
        exact = (2 * y[i] - 1) * float(x[i] @ newton.fit(x, y, out, beta))
        assert abs(exact - margin[i]) <= error[i]


def test_fit_is_stationary_with_penalised_intercept():
    rng = np.random.default_rng(5)
    x = np.hstack([rng.normal(size=(50, 3)), np.ones((50, 1))])
    y = (rng.random(50) > 0.2).astype(float)
    w = rng.random(50)
    beta = newton.fit(x, y, w)
    assert np.abs(beta + x.T @ (w * (newton.sigmoid(x @ beta) - y))).max() < 1e-8


def test_single_class_fold_has_no_accuracy():
    x = np.ones((5, 2))
    assert np.isnan(newton.leave_one_out_hits(x, np.array([0.0, 1, 1, 1, 1])))


def test_prices_prove_every_assignment():
    rng = np.random.default_rng(7)
    for _ in range(300):
        weight = rng.normal(size=(rng.integers(1, 9), rng.integers(1, 9))).round(int(rng.integers(0, 3)))
        found = priced_assignment(weight)
        paired = found.partner >= 0
        assert paired.sum() == min(weight.shape) == len(set(found.partner[paired]))
        assert found.total == pytest.approx(weight[np.flatnonzero(paired), found.partner[paired]].sum())
        assert found.total == pytest.approx(found.row_price.sum() + found.column_price.sum())
        assert (weight <= found.row_price[:, None] + found.column_price[None, :] + 1e-9).all()
        if weight.shape[0] != weight.shape[1]:
            longer = found.row_price if weight.shape[0] > weight.shape[1] else found.column_price
            assert (longer >= -1e-9).all()


def test_matrices_solved_together_equal_those_alone(monkeypatch):
    rng = np.random.default_rng(11)
    weights = [rng.normal(size=(rng.integers(0, 7), rng.integers(0, 7))).round(int(rng.integers(0, 3))) for _ in range(200)]
    for cells in (1, 100, 1 << 17):
        monkeypatch.setattr(assignment, "CELLS_AT_ONCE", cells)
        found = assignment.priced_assignments(weights)
        for weight, solved, best in zip(weights, found, assignment.best_assignments(weights), strict=True):
            few = weight if weight.shape[0] <= weight.shape[1] else weight.T
            brute = max(
                sum(few[i, j] for i, j in enumerate(order)) for order in itertools.permutations(range(few.shape[1]), few.shape[0])
            )
            assert solved.total == pytest.approx(brute, abs=1e-9) and best == pytest.approx(brute, abs=1e-9)
            assert solved.row_price.shape + solved.column_price.shape == weight.shape
