"""N-gram language model as a weighted backoff automaton.

``language_model`` lays out the part of the model that a block of texts can
reach as such an automaton and walks it once over each text. ``build`` makes a
whole small model from counted n-grams. Tokens of the model are numbered;
what the model has no number or no arc for is scored by the unigram base alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BEGIN, END = 0, 1
#: Tokens of a piece; the pieces of a line are walked side by side.
PIECE = 128


@dataclass
class Automaton:
    """States are histories; state 0 knows nothing.

    ``codes`` are the arcs as state * width + token, sorted, ``weights`` their
    log10 probabilities and ``targets`` the states they lead to. ``fail`` and
    ``backoff`` are the failure arcs with their log10 weights,
    ``weight_to_root`` sums them along the way down, and ``start[token]`` is
    the state behind a token that was scored in state 0; ``begin`` is the
    token before a text. A state knows ``reach`` tokens at most.
    """

    width: int
    codes: np.ndarray
    weights: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    backoff: np.ndarray
    weight_to_root: np.ndarray
    start: np.ndarray
    reach: int
    begin: int = BEGIN

    @property
    def arcs(self) -> dict[int, tuple[float, int]]:
        """The arcs of a small model by code."""
        return dict(zip(self.codes.tolist(), zip(self.weights.tolist(), self.targets.tolist(), strict=True), strict=True))

    def step(self, state: np.ndarray, token: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probabilities of a token in each of some states, and the states behind them."""
        known, begins = token >= 0, token == self.begin
        gain, behind = alone.copy(), np.where(known, self.start[token], 0)
        gain[~known] += self.weight_to_root[state[~known]]
        gain[begins] = 0.0
        open = np.flatnonzero(known & ~begins & (state > 0))
        at, lowered = state[open], np.zeros(len(open))
        while len(open):
            code = at * self.width + token[open]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            found = self.codes[place] == code
            arc = place[found]
            gain[open[found]] = lowered[found] + self.weights[arc]
            behind[open[found]] = self.targets[arc]
            open, at, lowered = open[~found], at[~found], lowered[~found]
            lowered += self.backoff[at]
            at = self.fail[at]
            rooted = at == 0
            gain[open[rooted]] += lowered[rooted]
            open, at, lowered = open[~rooted], at[~rooted], lowered[~rooted]
        return gain, behind

    def walk(self, line: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """log10 probabilities of the tokens of texts that lie behind each other.

        ``begin`` stands before each text and counts nothing; tokens the model
        has not are -1; ``alone`` holds the log10 unigram probabilities. The
        line is walked in pieces from left to right. A state is settled by the
        last ``reach`` tokens, so a piece sets out from state 0 that far ahead
        of its own first token.
        """
        pieces = -(-len(line) // PIECE)
        rest = pieces * PIECE - len(line)
        tokens = np.pad(line, (self.reach, rest), constant_values=-1)
        alone = np.pad(alone, (self.reach, rest))
        places = np.arange(pieces) * PIECE
        gains, state = np.zeros(pieces * PIECE), np.zeros(pieces, np.int64)
        for ahead in range(-self.reach, PIECE):
            here = places + ahead
            gain, state = self.step(state, tokens[here + self.reach], alone[here + self.reach])
            if ahead >= 0:
                gains[here] = gain
        return gains[: len(line)]

    def score(self, tokens: list[int], base: list[float]) -> float:
        """log10 probability of a text; ``tokens`` are -1 where the model has
        none, ``base`` holds the log10 unigram probability of every token."""
        return float(self.walk(np.array([self.begin, *tokens], np.int64), np.array([0.0, *base])).sum())


def automaton(width: int, codes, weights, targets, fail, backoff, start, reach: int, begin: int = BEGIN) -> Automaton:
    """An automaton of arcs in any order."""
    codes, fail, backoff = np.asarray(codes, np.int64), np.asarray(fail, np.int64), np.asarray(backoff, float)
    order = np.argsort(codes)
    to_root, at = backoff.copy(), fail
    while at.any():
        to_root += backoff[at]
        at = fail[at]
    weights, targets = np.asarray(weights, float)[order], np.asarray(targets, np.int64)[order]
    return Automaton(width, codes[order], weights, targets, fail, backoff, to_root, np.asarray(start, np.int64), reach, begin)


def build(width: int, unigram: np.ndarray, seen: np.ndarray, orders: list[tuple[np.ndarray, np.ndarray]], discount: float) -> Automaton:
    """The automaton of counted n-grams.

    ``unigram`` are base probabilities of the numbered tokens, ``seen`` how
    often each is followed by something, ``orders`` the kept (grams, counts)
    of length 2, 3, ..., where the first and the last tokens of every kept
    gram are kept grams themselves. Counts are lowered by ``discount``; what
    is left over goes to the failure arc, so each state's probabilities of all
    words sum to 1.
    """
    count = {(w,): int(seen[w]) for w in range(width)}
    prob: dict[tuple, float] = {(w,): float(unigram[w]) for w in range(width)}
    followers: dict[tuple, list[int]] = {}
    for grams, counts in orders:
        for gram, n in zip(map(tuple, grams.tolist()), counts.tolist(), strict=True):
            history = gram[:-1]
            count[gram] = n
            prob[gram] = (n - discount) / count[history]
            followers.setdefault(history, []).append(gram[-1])
    number = {history: i + 1 for i, history in enumerate(followers)}

    def state_of(history: tuple) -> int:
        while history:
            if history in number:
                return number[history]
            history = history[1:]
        return 0

    codes, weights, targets = [], [], []
    fail, backoff = [0], [0.0]
    for history, words in followers.items():
        kept = sum(prob[(*history, w)] for w in words)
        lower = sum(prob[(*history[1:], w)] for w in words)
        for w in words:
            codes.append(number[history] * width + w)
            weights.append(np.log10(prob[(*history, w)]))
            targets.append(state_of((*history, w)))
        fail.append(state_of(history[1:]))
        backoff.append(float(np.log10(max(1 - kept, 1e-12) / max(1 - lower, 1e-12))))
    start = [state_of((w,)) for w in range(width)]
    return automaton(width, codes, weights, targets, fail, backoff, start, len(orders))
