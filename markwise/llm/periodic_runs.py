"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``max(24, 3 q)``
words long, that no neighbouring word extends. The texts of a batch are put
behind each other with words between them that occur once, so one set of array
operations serves all of them and no run crosses a border.

Prefix doubling names every stretch of 2^k words by the place of its group in
the suffix array. A run of period q, 2^k <= q < 2^(k+1), holds an aligned block
of 2^k words whose copy q words further lies in it, too. So every aligned block
asks for its next occurrences in the window behind it: a range successor query
over its part of the suffix array, answered by a wavelet tree. Occurrences that
follow each other at half a block or less are a progression: the block has that
period, and a longer period of the run must shift one end of this inner
repetition to the same end around the progression, which leaves two candidates.
Any other occurrence is a candidate itself. Candidates are extended to both
sides with the names of the doubling; for one stretch the smallest period found
is its period. The lowest blocks, eight words, also serve the shorter periods.

Defined results: a null, empty or blank text has no words and no runs. Rows are
taken as they are, repeated ones, too. A row without an id is not rewritten
(``rewritten``). An empty table gives an empty result. A column with the name of
an output column gives way to it. A text is worked on whole, in memory of about
200 bytes a word, so one of ten million words fits in a task of two gigabytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, table, texts_of

#: A run has at least so many words, and so many of its periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The lowest blocks have 2^LOWEST words: a run of LEAST_WORDS words holds an
#: aligned one and its copy for each period up to that many words.
LOWEST = 3
#: Words that are put behind each other at a time; a longer text stands alone.
BATCH_WORDS = 200_000


class Factors:
    """Names of all stretches of 2^k words of a sequence, and its suffix array.

    The sequence must begin and end with items that occur once. A name is the
    first place of the stretch's group in the suffix array, so a group is the
    places from its name on. Doubling ends when no two names are equal; each
    step sorts only what is not told apart yet.
    """

    def __init__(self, items: np.ndarray):
        n = len(items)
        places = np.argsort(items, kind="stable")
        ordered = items[places]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        names = np.empty(n, np.int32)
        names[places] = np.repeat(first, np.diff(np.append(first, n)))
        self.names, self.places = [names], places
        length = 1
        while True:
            own = names[places]
            same = own[1:] == own[:-1]
            tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
            if not len(tied):
                return
            at = places[tied]
            keys = own[tied].astype(np.int64) << 32 | names[at + length]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            places[tied] = at
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            names = names.copy()
            names[at] = np.repeat(tied[first], np.diff(np.append(first, len(at)))).astype(np.int32)
            self.names.append(names)
            length *= 2

    def agree_from(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items from a on equal those from b on (a differs from b)."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            done += (names[a + done] == names[b + done]).astype(np.int64) << k
        return done

    def agree_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items before a equal those before b."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            one, other = a - done - (1 << k), b - done - (1 << k)
            fits = (one >= 0) & (other >= 0)
            done += (fits & (names[np.maximum(one, 0)] == names[np.maximum(other, 0)])).astype(np.int64) << k
        return done


class RangeSuccessor:
    """The smallest value from a bound on within a range of a permutation (wavelet tree)."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, (self.n - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def _below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of places [low, high) lie below the bound."""
        count = np.zeros(len(low), np.int64)
        for before, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            left, right, all_ = before[low], before[high], before[-1]
            up = (bound >> bit) & 1 == 1
            count += np.where(up, right - left, 0)
            low, high = np.where(up, all_ + low - left, left), np.where(up, all_ + high - right, right)
        return count

    def _ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        value = np.zeros(len(low), np.int64)
        for before, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            left, right, all_ = before[low], before[high], before[-1]
            up = rank >= right - left
            value |= up.astype(np.int64) << bit
            rank = rank - np.where(up, right - left, 0)
            low, high = np.where(up, all_ + low - left, left), np.where(up, all_ + high - right, right)
        return value

    def find(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Per query the smallest value >= bound in places [low, high), n if there is none."""
        found = np.full(len(low), self.n, np.int64)
        rank = self._below(low, high, np.minimum(bound, self.n - 1))
        some = np.flatnonzero((rank < high - low) & (bound < self.n))
        found[some] = self._ranked(low[some], high[some], rank[some])
        return found


def candidates(factors: Factors, k: int, successor: RangeSuccessor) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs that the aligned blocks of 2^k items propose."""
    names, size = factors.names[k], 1 << k
    n = len(names)
    members = np.bincount(names, minlength=n)
    start = np.arange(0, n - size + 1, size)
    start = start[members[names[start]] > 1]
    low = names[start].astype(np.int64)
    high = low + members[low]
    nearest, lowest = (1, True) if k == LOWEST else (size, False)
    at, places, periods = start + nearest, [], []
    while len(start):
        found = successor.find(low, high, at)
        near = np.flatnonzero(found < np.minimum(start + 2 * size, n))
        start, low, high, found = start[near], low[near], high[near], found[near]
        if lowest:
            places.append(start)
            periods.append(found - start)
            at = found + 1
            continue
        following = successor.find(low, high, found + 1)
        step = following - found
        chain = (following < n) & (step <= size // 2)
        places.append(start[~chain])
        periods.append((found - start)[~chain])
        at = found + 1
        s, o, r = start[chain], found[chain], step[chain]
        s_end, s_begin = s + r + factors.agree_from(s, s + r), s - factors.agree_before(s, s + r)
        o_end, o_begin = o + r + factors.agree_from(o, o + r), o - factors.agree_before(o, o + r)
        places += [s, s]
        periods += [o_end - s_end, o_begin - s_begin]
        at[chain] = o_end - size + 1
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs(items: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period.

    ``items`` are numbers, the first and the last of which occur once.
    """
    none = np.empty((0, 3), np.int64)
    factors = Factors(items)
    if len(factors.names) <= LOWEST + 1:
        return none  # no eight words occur twice
    successor = RangeSuccessor(factors.places)
    pairs = [candidates(factors, k, successor) for k in range(LOWEST, len(factors.names) - 1)]
    place = np.concatenate([p for p, _ in pairs])
    period = np.concatenate([q for _, q in pairs])
    fits = (period > 0) & (place + period < len(items))
    tried = np.unique(np.stack([place[fits], period[fits]], 1), axis=0)
    if not len(tried):
        return none
    place, period = tried[:, 0], tried[:, 1]
    start = place - factors.agree_before(place, place + period)
    end = place + period + factors.agree_from(place, place + period)
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    found = np.stack([start, end, period], 1)[long]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))[: len(found)]
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Rows (start, length, period) per text, given as words."""
    numbers = Numbers()
    parts, starts, at = [np.array([0])], [], 1
    for words in texts:
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) + len(texts) + 1)
        parts.append(np.array([len(starts) + 1]))
        starts.append(at)
        at += len(words) + 1
    found = runs(np.concatenate(parts))
    text = np.searchsorted(starts, found[:, 0], "right") - 1
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    result = []
    for number, begin in enumerate(starts):
        own = found[bounds[number] : bounds[number + 1]]
        result.append(np.stack([own[:, 0] - begin, own[:, 1] - own[:, 0], own[:, 2]], 1))
    return result


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not len(found):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a tail that repeats, in about every tenth document.

    Which documents, from where and with what period goes by the checksum of
    the id. A row without an id stays as it is.
    """
    if doc_id is None or not words:
        return words
    checksum = zlib.crc32(str(doc_id).encode())
    if checksum % 10:
        return words
    n, g = len(words), checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


RUNS = T.StructType(
    [
        T.StructField("n_runs", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("period", T.LongType()),
        T.StructField("exponent_milli", T.LongType()),
        T.StructField("runs_sha256", T.StringType()),
        T.StructField("collapsed_sha256", T.StringType()),
        T.StructField(
            "runs",
            T.ArrayType(
                T.StructType(
                    [T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]
                ),
                False,
            ),
        ),
        T.StructField("collapsed", T.StringType()),
    ]
)


def described(words: list[bytes], found: np.ndarray, whole: bool) -> tuple:
    rows = [tuple(int(v) for v in row) for row in found]
    best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    rest = b" ".join(collapsed(words, found))
    return (
        len(rows),
        *best,
        1000 * best[1] // best[2] if rows else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(rest).hexdigest(),
        [dict(zip(("start", "length", "period"), row, strict=True)) for row in rows] if whole else None,
        rest.decode() if whole else None,
    )


def periodic_runs(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    change: Callable[[list[bytes], int | None], list[bytes]] | None = None,
    whole: bool = True,
    batch_words: int = BATCH_WORDS,
) -> DataFrame:
    """``df[keep]`` with the columns ``RUNS``.

    start, length, period and exponent_milli are those of the run of the greatest
    exponent (then smallest start, then period), null without runs. ``runs``
    lists all of them and ``collapsed`` is the text without repetitions, words
    joined by a space; both are null unless ``whole``. ``change`` may replace the words first.
    """

    def make():
        def work(ids, texts):
            rows: list[tuple] = []
            keys, raw = ids.to_pylist(), texts_of(texts)
            words: list[list[bytes]] = []
            held = 0

            def finish():
                for own, found in zip(words, runs_of_texts(words), strict=True):
                    rows.append(described(own, found, whole))
                words.clear()

            for key, value in zip(keys, raw, strict=True):
                own = value.split() if value else []
                if change:
                    own = change(own, key)
                if held + len(own) > batch_words:
                    finish()
                    held = 0
                words.append(own)
                held += len(own) + 1
            finish()
            return [list(column) for column in zip(*rows, strict=True)] if rows else [[] for _ in RUNS]

        return work

    return add_columns(df, [id, text], RUNS, make, [id] if keep is None else keep)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), change=rewritten, whole=False)
    return found.drop("runs", "collapsed")
