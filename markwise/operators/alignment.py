"""Word alignment of answers with ideals, on distinct (answer, ideal) pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.operators.assignment import alignment_scores, leftover_matrix, priced_assignments, unit_rows
from markwise.operators.embedding import block_vectors, by_block, summed_vectors, vector_width
from markwise.operators.skew import salted_join


def leftover_words(pairs: DataFrame) -> DataFrame:
    """Adds what remains on each side once shared words are taken out."""
    return pairs.select(
        "*",
        F.size(F.array_intersect("tokens", "ideal_tokens")).alias("n_shared"),
        F.array_except("tokens", "ideal_tokens").alias("answer_left"),
        F.array_except("ideal_tokens", "tokens").alias("ideal_left"),
        F.size(F.array_distinct("ideal_tokens")).alias("n_ideal"),
    )


def _vectors(column: pa.ListArray, width: int) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return [unit_rows(flat[a:b].reshape(-1, width).astype(np.float64)) for a, b in zip(offsets, offsets[1:])]


#: Words of the answers that are aligned in one task at a time, and pairs that are laid out at a time.
PAIR_WORDS, PAIRS_AT_ONCE = 1 << 17, 256
CERTIFICATE = (
    "answer_words array<string>, ideal_words array<string>, partner array<int>, answer_prices array<double>, ideal_prices array<double>"
)
_CERTIFICATE_TYPES = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]


def _places(known: pa.Table, width: int) -> tuple[dict[str, int], np.ndarray]:
    """Places of a block's known words, and their vectors."""
    words, matrix = block_vectors(known, width)
    order = {w: k for k, w in enumerate(words.to_pylist())}
    if len(order) < len(words):  # of several vectors of a word, the greatest is taken
        ranked = sorted(range(len(words)), key=lambda k: matrix[k].tolist())
        order = {words[k].as_py(): k for k in ranked}
    return order, matrix


def _sides(rows: pa.Table, known: pa.Table, width: int) -> Iterator[list[tuple]]:
    """Arguments of ``alignment_scores``, some rows at a time."""
    places, matrix = _places(known, width)
    units = unit_rows(matrix.astype(np.float64))
    for start in range(0, rows.num_rows, PAIRS_AT_ONCE):
        some = rows.slice(start, PAIRS_AT_ONCE)
        pairs = zip(some["tokens"].to_pylist(), some["ideal_tokens"].to_pylist(), strict=True)
        yield [(set(answer), set(ideal), places, units, places, units) for answer, ideal in pairs]


def _score_block(width: int, keys: list[str]):
    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        scores = [x for sides in _sides(rows, known, width) for x in alignment_scores(sides)]
        return pa.table([*[rows[k] for k in keys], pa.array(scores, pa.float64())], [*keys, "alignment"])

    return score


def _compare_block(width: int, keys: list[str]):
    def compare(rows: pa.Table, known: pa.Table) -> pa.Table:
        words, sums, times = summed_vectors(*block_vectors(known, width))
        summed = {w: k for k, w in enumerate(words.to_pylist())}
        scores, means = [], np.zeros((rows.num_rows, width))
        for sides in _sides(rows, known, width):
            for i, (answer, *_) in enumerate(sides, len(scores)):
                at = [summed[w] for w in sorted(answer) if w in summed]
                if at:
                    means[i] = sums[at].sum(axis=0, dtype=np.float64) / times[at].sum()
            scores.extend(alignment_scores(sides))
        ends = pa.array(np.arange(rows.num_rows + 1) * width, pa.int32())
        return pa.table(
            [*[rows[k] for k in keys], pa.array(scores, pa.float64()), pa.ListArray.from_arrays(ends, pa.array(means.reshape(-1)))],
            [*keys, "alignment", "vector"],
        )

    return compare


def _certify_block(width: int, keys: list[str]):
    def certify(rows: pa.Table, known: pa.Table) -> pa.Table:
        made = []
        for sides in _sides(rows, known, width):
            answers, ideals, weights = zip(*[leftover_matrix(*side) for side in sides], strict=True)
            for answer, ideal, found in zip(answers, ideals, priced_assignments(list(weights)), strict=True):
                made.append((answer, ideal, found.partner.tolist(), found.row_price.tolist(), found.column_price.tolist()))
        columns = zip(*made, strict=True) if made else [()] * 5
        names = [field.split()[0] for field in CERTIFICATE.split(", ")]
        return pa.table(
            [*[rows[k] for k in keys], *[pa.array(c, k) for c, k in zip(columns, _CERTIFICATE_TYPES, strict=True)]], [*keys, *names]
        )

    return certify


def word_alignment(
    answers: DataFrame, ideals: DataFrame, vocabulary: DataFrame, answer_key: str, ideal_keys: list[str], width: int
) -> DataFrame:
    """(answer_key, ideal_keys…, alignment) for every answer and its ideals.

    ``answers``: (answer_key, ideal_keys…, tokens), one row per pair wanted;
    ``ideals``: (ideal_keys…, ideal_tokens). A block of pairs gets the vectors
    of its distinct words once. The pair where one side has nothing left over
    never leaves the JVM.
    """
    keys = [answer_key, *ideal_keys]
    easy, hard = _settled(answers, ideals, answer_key, ideal_keys)
    types = dict(hard.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", alignment double"
    found = by_block(hard, ["tokens", "ideal_tokens"], vocabulary, _score_block(width, keys), schema, PAIR_WORDS)
    return easy.unionByName(found)


def aligned_means(pairs: DataFrame, vocabulary: DataFrame, width: int) -> DataFrame:
    """Adds the alignment of tokens and ideal_tokens and the mean vector of the tokens, in
    their place. Both need the vectors of the answer's words, which are sent once."""
    types = {k: t for k, t in pairs.dtypes if k not in ("tokens", "ideal_tokens")}
    schema = ", ".join(f"`{k}` {t}" for k, t in types.items()) + ", alignment double, vector array<double>"
    return by_block(pairs, ["tokens", "ideal_tokens"], vocabulary, _compare_block(width, list(types)), schema, PAIR_WORDS)


def _settled(
    answers: DataFrame, ideals: DataFrame, answer_key: str, ideal_keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Pairs settled at once, with their alignment, and the others with their tokens."""
    pairs = salted_join(answers, ideals, ideal_keys, answer_key, "inner")
    left = F.array_except("tokens", "ideal_tokens")
    right = F.array_except("ideal_tokens", "tokens")
    n_ideal = F.size(F.array_distinct("ideal_tokens"))
    direct = (
        F.when(F.size(right) == 0, F.lit(1.0))
        .when(F.size(left) == 0, F.size(F.array_intersect("tokens", "ideal_tokens")) / n_ideal)
    )
    pairs = pairs.withColumn("alignment", direct)
    keys = [answer_key, *ideal_keys]
    easy = pairs.filter("alignment IS NOT NULL").select(*keys, "alignment")
    hard = pairs.filter("alignment IS NULL").filter(F.col(answer_key).isNotNull())
    return easy, hard.select(*keys, "tokens", "ideal_tokens")


def alignment_certificates(
    answers: DataFrame, ideals: DataFrame, vocabulary: DataFrame, answer_key: str, ideal_keys: list[str], width: int
) -> DataFrame:
    """The pairs that need an assignment, each with its solution and its prices:
    the keys, tokens, ideal_tokens and the columns ``CERTIFICATE``."""
    keys = [answer_key, *ideal_keys, "tokens", "ideal_tokens"]
    _, hard = _settled(answers, ideals, answer_key, ideal_keys)
    types = dict(hard.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {CERTIFICATE}"
    return by_block(hard, ["tokens", "ideal_tokens"], vocabulary, _certify_block(width, keys), schema, PAIR_WORDS)


def _check_block(width: int, keys: list[str], tolerance: float):
    def checked(answer, ideal, partner, answer_price, ideal_price, places, matrix):
        """Weight, sums of both sides' prices and feasibility of one certificate."""
        weight = np.zeros((len(answer), len(ideal)))
        rows = [i for i, w in enumerate(answer) if w in places]
        columns = [j for j, w in enumerate(ideal) if w in places]
        if rows and columns:
            sides = [unit_rows(matrix[[places[words[k]] for k in at]].astype(np.float64)) for words, at in ((answer, rows), (ideal, columns))]
            weight[np.ix_(rows, columns)] = sides[0] @ sides[1].T
        partner, answer_price, ideal_price = np.array(partner, int), np.array(answer_price), np.array(ideal_price)
        own = np.flatnonzero(partner >= 0)
        feasible = len(own) == len(np.unique(partner[own])) == min(weight.shape)
        feasible &= bool((weight <= answer_price[:, None] + ideal_price[None, :] + tolerance).all())
        if len(answer) != len(ideal):
            feasible &= bool((answer_price if len(answer) > len(ideal) else ideal_price).min() >= -tolerance)
        return float(weight[own, partner[own]].sum()), float(answer_price.sum()), float(ideal_price.sum()), feasible

    def check(rows: pa.Table, known: pa.Table) -> pa.Table:
        places, matrix = _places(known, width)
        names = [field.split()[0] for field in CERTIFICATE.split(", ")]
        found = [checked(*row, places, matrix) for row in zip(*[rows[n].to_pylist() for n in names], strict=True)]
        columns = zip(*found, strict=True) if found else [()] * 4
        types = [pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        return pa.table(
            [*[rows[k] for k in keys], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            [*keys, "primal", "answer_sum", "ideal_sum", "feasible"],
        )

    return check


def checked_certificates(
    certificates: DataFrame, ideals: DataFrame, vocabulary: DataFrame, answer_key: str, ideal_keys: list[str],
    tolerance: float = 1e-6,
) -> DataFrame:
    """(keys, primal, dual, feasible) of certificates, by similarities that are
    computed here, apart from the solver.

    primal is the weight of the pairs, dual the sum of the prices. feasible says that the
    pairs are as many as can be, no partner is used twice, no edge weighs more
    than its two prices, and the longer side has no negative price. Words
    without a vector stand for zero rows. A block of certificates gets the
    vectors of its distinct words once, and a certificate is one small matrix.
    A certificate names its ideal's words itself; ``ideals`` is not read.
    """
    keys = [answer_key, *ideal_keys]
    names = [field.split()[0] for field in CERTIFICATE.split(", ")]
    rows = certificates.select(*keys, *names)
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", primal double, answer_sum double, ideal_sum double, feasible boolean"
    work = _check_block(vector_width(vocabulary), keys, tolerance)
    checked = by_block(rows, ["answer_words", "ideal_words"], vocabulary, work, schema, PAIR_WORDS)
    # several certificates of one pair use a partner twice
    return checked.groupBy(*keys).agg(
        F.sum("primal").alias("primal"), (F.sum("answer_sum") + F.first("ideal_sum")).alias("dual"),
        (F.every("feasible") & (F.count(F.lit(1)) == 1)).alias("feasible"),
    )
