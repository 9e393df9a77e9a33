"""Alignment of two word sets: the numpy part that runs inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Assignment:
    """Forced one-to-one pairs of the largest total weight, with its proof.

    ``partner`` is the column of each row (-1: none). Prices of rows and columns sum to the
    total; no edge weighs more than the prices of its ends; the prices of the
    longer side are not negative. So no other choice of as many pairs weighs more.
    """

    total: float
    partner: np.ndarray
    row_price: np.ndarray
    column_price: np.ndarray


#: Numbers in the matrices that are solved side by side.
CELLS_AT_ONCE = 1 << 17


def best_assignment(weight: np.ndarray) -> float:
    """Largest total weight of min(rows, columns) forced one-to-one pairs."""
    return best_assignments([weight])[0]


def best_assignments(weights: list[np.ndarray]) -> list[float]:
    """``best_assignment`` of each matrix."""
    hard = [i for i, weight in enumerate(weights) if min(weight.shape) > 1]
    found = [float(weight.max()) if min(weight.shape) else 0.0 for weight in weights]
    for i, solved in zip(hard, priced_assignments([weights[i] for i in hard]), strict=True):
        found[i] = solved.total
    return found


def priced_assignment(weight: np.ndarray) -> Assignment:
    return priced_assignments([weight])[0]


def priced_assignments(weights: list[np.ndarray]) -> list[Assignment]:
    """Shortest augmenting paths with dual prices; matrices of about the same
    size take each step of their paths together.
    """
    turned = [weight.T if weight.shape[0] > weight.shape[1] else weight for weight in weights]
    found: list[Assignment | None] = [None] * len(weights)
    together: list[int] = []
    rows = 0

    def solve() -> None:
        for i, solved in zip(together, _solved([turned[i] for i in together]), strict=True):
            if turned[i] is not weights[i]:
                partner = np.full(weights[i].shape[0], -1)
                partner[solved.partner] = np.arange(len(solved.partner))
                solved = Assignment(solved.total, partner, solved.column_price, solved.row_price)
            found[i] = solved

    for i in sorted(range(len(weights)), key=lambda i: turned[i].shape[::-1]):
        if not len(turned[i]):
            found[i] = Assignment(0.0, *_nothing(weights[i].shape))
            continue
        rows = max(rows, len(turned[i]))
        if together and (len(together) + 1) * rows * turned[i].shape[1] > CELLS_AT_ONCE:
            solve()
            together, rows = [], len(turned[i])
        together.append(i)
    if together:
        solve()
    return found


def _nothing(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.full(shape[0], -1), np.zeros(shape[0]), np.zeros(shape[1])


def _solved(weights: list[np.ndarray]) -> list[Assignment]:
    """Of matrices with one row at least and no more rows than columns. They are
    padded with columns that cost infinitely much and rows that ask for nothing.
    """
    rows = np.array([len(weight) for weight in weights])
    cost = np.full((len(weights), rows.max(), max(weight.shape[1] for weight in weights)), np.inf)
    for of, weight in zip(cost, weights, strict=True):
        of[: weight.shape[0], : weight.shape[1]] = weight.max() - weight
    each, real = np.arange(len(weights)), np.arange(cost.shape[1]) < rows[:, None]
    row_price = np.where(real, cost.min(axis=2), 0.0)
    column_price = np.zeros((len(weights), cost.shape[2]))
    owner = np.full(column_price.shape, -1)
    # greedy start: cheapest column of each row where nobody has it yet
    nearest = cost.argmin(axis=2)
    for row in range(cost.shape[1]):
        free = real[:, row] & (owner[each, nearest[:, row]] < 0)
        owner[each[free], nearest[free, row]] = row
        real[free, row] = False
    pending, queue = real.sum(axis=1), np.argsort(~real, axis=1, kind="stable")
    for turn in range(pending.max()):
        who = np.flatnonzero(pending > turn)
        _augment(cost, row_price, column_price, owner, who, queue[who, turn])
    found = []
    for i, weight in enumerate(weights):
        n, m = weight.shape
        taken = np.flatnonzero(owner[i] >= 0)
        partner = np.empty(n, int)
        partner[owner[i, taken]] = taken
        total = float(weight[owner[i, taken], taken].sum())
        found.append(Assignment(total, partner, weight.max() - row_price[i, :n], -column_price[i, :m]))
    return found


def _augment(cost, row_price, column_price, owner, who: np.ndarray, start: np.ndarray) -> None:
    """Finds a column for one more row, ``start``, of each of the matrices ``who``."""
    shape = len(who), cost.shape[2]
    distance, parent, closed = np.full(shape, np.inf), np.full(shape, -1), np.zeros(shape, bool)
    row, reached, at = start.copy(), np.zeros(len(who)), np.full(len(who), -1)
    left = np.arange(len(who))
    while len(left):
        of, by = who[left], row[left]
        step = cost[of, by] - column_price[of] + (reached[left] - row_price[of, by])[:, None]
        near, shut = distance[left], closed[left]
        better = ~shut & (step < near - 1e-15)
        near = np.where(better, step, near)
        distance[left] = near
        parent[left] = np.where(better, at[left, None], parent[left])
        near[shut] = np.inf
        at[left] = column = near.argmin(axis=1)
        reached[left] = near[np.arange(len(left)), column]
        holder = owner[of, column]
        taken = holder >= 0
        left = left[taken]
        closed[left, column[taken]] = True
        row[left] = holder[taken]
    one, column = np.nonzero(closed)
    slack = reached[one] - distance[one, column]
    row_price[who[one], owner[who[one], column]] += slack
    column_price[who[one], column] -= slack
    row_price[who, start] += reached
    left = np.arange(len(who))
    while len(left):
        before = parent[left, at[left]]
        first = before < 0
        owner[who[left[first]], at[left[first]]] = start[left[first]]
        left, before = left[~first], before[~first]
        owner[who[left], at[left]] = owner[who[left], before]
        at[left] = before


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def leftover_matrix(
    answer: set[str], ideal: set[str], answer_vectors: dict[str, int], answer_units: np.ndarray,
    ideal_vectors: dict[str, int], ideal_units: np.ndarray,
) -> tuple[list[str | None], list[str | None], np.ndarray]:
    """What stands at the rows and columns, and their similarities.

    Words without a vector are similar to nothing (0): they stand in the
    matrix as zero rows or columns (None), no more of them than can be matched.
    """
    left, right = answer - ideal, ideal - answer
    rows = [w for w in sorted(left) if w in answer_vectors]
    columns = [w for w in sorted(right) if w in ideal_vectors]
    pairs = min(len(left), len(right))
    blank_rows = min(len(left) - len(rows), pairs)
    blank_columns = min(len(right) - len(columns), pairs)
    weight = np.zeros((len(rows) + blank_rows, len(columns) + blank_columns))
    if rows and columns:
        units = answer_units[[answer_vectors[w] for w in rows]], ideal_units[[ideal_vectors[w] for w in columns]]
        weight[: len(rows), : len(columns)] = units[0] @ units[1].T
    return [*rows, *[None] * blank_rows], [*columns, *[None] * blank_columns], weight


def alignment_score(
    answer: set[str], ideal: set[str], answer_vectors: dict[str, int], answer_units: np.ndarray,
    ideal_vectors: dict[str, int], ideal_units: np.ndarray,
) -> float:
    """(shared words + best assignment of the others) / size of the ideal set."""
    return alignment_scores([(answer, ideal, answer_vectors, answer_units, ideal_vectors, ideal_units)])[0]


def alignment_scores(sides: list[tuple]) -> list[float]:
    """``alignment_score`` of the arguments of each."""
    scores, hard, weights = [], [], []
    for i, (answer, ideal, *vectors) in enumerate(sides):
        left, right = answer - ideal, ideal - answer
        scores.append((len(ideal) - len(right)) / len(ideal) if right else 1.0)
        if left and right:
            hard.append(i)
            weights.append(leftover_matrix(answer, ideal, *vectors)[2])
    for i, best in zip(hard, best_assignments(weights), strict=True):
        answer, ideal = sides[i][:2]
        scores[i] = (len(answer & ideal) + best) / len(ideal)
    return scores
