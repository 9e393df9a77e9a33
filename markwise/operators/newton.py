"""Penalised logistic regression: the numpy part that runs inside tasks.

Objective: half the squared length of all coefficients, intercept included,
plus the weighted log losses. Labels are 0/1; the last column of ``x`` is 1.
"""

from __future__ import annotations

import numpy as np

#: Of the loss: how much a last full step would still have gained.
TOLERANCE = 1e-18
#: The same for a search that rounding brings to a stand; beyond it, it failed.
STALLED = 1e-12
#: Evaluations of the objective, step halvings included.
MAX_STEPS = 100


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def class_weights(n_bad: float, n_good: float) -> tuple[float, float]:
    n = n_bad + n_good
    return n / (2 * n_bad), n / (2 * n_good)


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the data part."""
    z = x @ beta
    p = sigmoid(z)
    loss = float(w @ (np.logaddexp(0, z) - y * z))
    return loss, x.T @ (w * (p - y)), (x.T * (w * p * (1 - p))) @ x


def penalised(beta, loss, gradient, hessian):
    return loss + 0.5 * float(beta @ beta), gradient + beta, hessian + np.eye(len(beta))


def converged(loss: float, gradient: np.ndarray, step: np.ndarray) -> bool:
    """Whether the Newton decrement is negligible; the same at every group size,
    as the loss and the decrement both grow with the number of rows."""
    return float(gradient @ step) <= TOLERANCE * (1 + abs(loss))


def stalled(loss: float, gradient: np.ndarray, step: np.ndarray, scale: float) -> bool:
    """Whether steps have become too short to go on; an error where the optimum is not near."""
    if scale >= 1e-6:
        return False
    if float(gradient @ step) > STALLED * (1 + abs(loss)):
        raise RuntimeError("the search for the optimum came to a stand before it")
    return True


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    beta = np.zeros(x.shape[1]) if start is None else start.copy()
    loss, gradient, hessian = penalised(beta, *sums(x, y, w, beta))
    step, scale = np.linalg.solve(hessian, gradient), 1.0
    for _ in range(MAX_STEPS):
        if converged(loss, gradient, step) or stalled(loss, gradient, step, scale):
            return beta
        trial = beta - scale * step
        values = penalised(trial, *sums(x, y, w, trial))
        if values[0] <= loss + 1e-12 * abs(loss):
            beta, (loss, gradient, hessian) = trial, values
            step, scale = np.linalg.solve(hessian, gradient), 1.0
        else:
            scale /= 2
    raise RuntimeError(f"no optimum within {MAX_STEPS} evaluations")


def leverages(x: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x @ np.linalg.inv(hessian), x)


def without_one(
    x: np.ndarray, y: np.ndarray, weight: float, beta: np.ndarray, hessian: np.ndarray, peak: float
) -> tuple[np.ndarray, np.ndarray]:
    """Signed margin of each row under the model fitted without it, and its error bound.

    ``beta`` and ``hessian`` belong to the fit on all rows with the fold's
    class weights; ``weight`` is the rows' own weight in it and ``peak`` the
    largest leverage of any row of the group. One Newton step takes the row
    out. The logistic loss changes its curvature along a step by at most
    exp(largest change of any row's margin), which bounds how far the exact
    optimum can be from where the step ends (generalised self-concordance,
    Bach 2010). An infinite bound means the row needs a fit of its own.
    """
    sign = 2 * y - 1
    p = sigmoid(x @ beta)
    own = leverages(x, hessian)
    shrink = 1 - weight * p * (1 - p) * own
    own_out, peak_out = own / shrink, np.sqrt(peak / shrink)
    pull = weight * np.abs(p - y)
    margin = sign * (x @ beta) - pull * own_out
    decrement = pull * np.sqrt(own_out)
    reach = peak_out * decrement
    growth = np.where(reach > 1e-8, np.expm1(reach) / np.maximum(reach, 1e-300) - 1, reach)
    bend = np.exp(reach / 2)
    rest = growth * decrement * bend
    room = peak_out * bend * rest
    usable = room < 0.9
    distance = -np.log1p(-np.where(usable, room, 0.0)) / np.maximum(peak_out * bend, 1e-300)
    error = np.sqrt(own_out) * bend * distance
    return margin, np.where(usable, error * (1 + 1e-6) + 1e-10, np.inf)


def leave_one_out_hits(x: np.ndarray, y: np.ndarray) -> float:
    """Number of rows predicted right by the model fitted without them; NaN if
    some fold has one class only."""
    n_good = float(y.sum())
    n_bad = len(y) - n_good
    if min(n_good, n_bad) < 2:
        return float("nan")
    hits = 0
    for label in (0, 1):
        w_bad, w_good = class_weights(n_bad - (label == 0), n_good - (label == 1))
        w = np.where(y == 1, w_good, w_bad)
        beta = fit(x, y, w)
        _, _, hessian = penalised(beta, *sums(x, y, w, beta))
        mine = np.flatnonzero(y == label)
        peak = float(leverages(x, hessian).max())
        margin, error = without_one(x[mine], y[mine], w_good if label else w_bad, beta, hessian, peak)
        hits += int((margin > error).sum())
        for row in mine[np.abs(margin) <= error]:
            others = np.ones(len(y))
            others[row] = 0
            z = float(x[row] @ fit(x, y, w * others, beta))
            hits += int((z > 0) == (label == 1))
    return float(hits)
