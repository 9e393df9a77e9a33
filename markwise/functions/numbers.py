"""Spelled-out English numbers, in any case, to digits, as one SQL expression.

Runs of number words are cut out with one regular expression; texts without
such a run pass through untouched. Inside a run a transducer goes over the
words and knows four kinds of them. Cardinals become one number as long as they
compose ("one hundred and five"), and a new number where they do not ("one
two"). An ordinal composes like its cardinal and closes the number ("twenty
first": 21st). "point" and the digits behind it add decimals ("three point one
four": 3.14). A half, a quarter or a plural ordinal behind a number makes a
fraction ("two thirds": 2/3). "one", "first", "second" and "third" stay words
where they stand alone; a denominator counts behind a cardinal only.

The expression is SQL text rather than nested ``Column`` calls, so building it
costs one call to the JVM.
"""

from __future__ import annotations

# --- fixed values: number words --------------------------------------------
NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
    "million": 1000000, "billion": 1000000000,
}

# --- fixed values: ordinals that are not their cardinal with "th" ------------
IRREGULAR = {
    "first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12,
    "twentieth": 20, "thirtieth": 30, "fortieth": 40, "fiftieth": 50, "sixtieth": 60, "seventieth": 70,
    "eightieth": 80, "ninetieth": 90,
}

ORDINALS = IRREGULAR | {f"{word}th": n for word, n in NUMBERS.items() if n and n not in IRREGULAR.values()}
# "second" is left out: its plural is a span of time
DENOMINATORS = {"half": 2, "halves": 2, "quarter": 4, "quarters": 4} | {
    f"{word}s": n for word, n in ORDINALS.items() if 3 <= n <= 10 or n in (100, 1000)
}
DIGITS = [word for word, n in NUMBERS.items() if n < 10]
#: Ordinals up to this stay words unless they compose.
PLAIN_ORDINALS = 3

_GAP = r"[\s\-]+"
_CARDINAL = "|".join(NUMBERS)


def _alternatives(words: list[str]) -> str:
    """A pattern for the words that tries a letter once for all words that begin with it."""
    letters: dict[str, list[str]] = {}
    for word in words:
        letters.setdefault(word[0], []).append(word[1:])
    found = []
    for letter, ends in letters.items():
        longer = [e for e in ends if e]
        rest = f"(?:{_alternatives(longer)})" if longer else ""
        found.append(letter + rest + ("?" if longer and len(longer) < len(ends) else ""))
    return "|".join(found)


# which of these words is tried first makes no difference, as only a whole one can be followed by what has to follow
_WORD = _alternatives([*NUMBERS, *ORDINALS])
_FOLLOWING = "|".join([*NUMBERS, *ORDINALS])
_PARTS = "|".join(DENOMINATORS)
_LINKED = "|".join(word for word, value in NUMBERS.items() if value >= 100)
RUN = (
    rf"(?i)(?=[{''.join(sorted({w[0] for w in [*NUMBERS, *ORDINALS]}))}])(?<![\p{{L}}\p{{N}}_'])(?:{_WORD})"
    rf"(?:(?:{_GAP}|(?<={_LINKED}){_GAP}and{_GAP})(?:{_FOLLOWING})"
    rf"|(?<={_CARDINAL}){_GAP}(?:{_PARTS})"
    rf"|(?<={_CARDINAL}){_GAP}point(?={_GAP}(?:{'|'.join(DIGITS)})(?![\p{{L}}\p{{N}}_'])))*"
    r"(?![\p{L}\p{N}_'])"
)

# a word as one number: its value, and its kind in what is above a billion
_ORDINAL, _PART, _POINT = 10**12, 2 * 10**12, 3 * 10**12
_CODES = NUMBERS | {w: _ORDINAL + n for w, n in ORDINALS.items()} | {w: _PART + n for w, n in DENOMINATORS.items()} | {"point": _POINT}
_TABLE = "map(" + ", ".join(f"'{word}', {value}L" for word, value in _CODES.items()) + ")"

# state: numbers already closed; thousands and up; 0..999; last scale word; decimals.
# total = -1 means that no number is open, decimals = null that there was no point.
_NEW_SCALE = "1000000000000L"
_START = f"named_struct('done', CAST(array() AS array<string>), 'total', -1L, 'part', 0L, 'scale', {_NEW_SCALE}, 'decimals', CAST(null AS string))"
_NUMBER = "concat(CAST(greatest(s.total, 0L) + s.part AS string), coalesce(concat('.', s.decimals), ''))"
_CLOSED = f"CASE WHEN s.total < 0 THEN s.done ELSE concat(s.done, array({_NUMBER})) END"


def _fits(v: str) -> str:
    return f"""(s.decimals IS NULL AND s.total + s.part > 0 AND {v} > 0 AND CASE
    WHEN {v} < 10 THEN s.part % 100 = 0 OR (s.part % 100 >= 20 AND s.part % 10 = 0)
    WHEN {v} < 100 THEN s.part % 100 = 0
    WHEN {v} = 100 THEN s.part BETWEEN 1 AND 9
    ELSE s.part > 0 AND {v} < s.scale END)"""


def _state(done: str, total: str = "-1L", part: str = "0L", scale: str = _NEW_SCALE, decimals: str = "CAST(null AS string)") -> str:
    return f"named_struct('done', {done}, 'total', {total}, 'part', {part}, 'scale', {scale}, 'decimals', {decimals})"


def _ordinal(n: str) -> str:
    suffix = f"CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END"
    return f"concat(CAST({n} AS string), {suffix})"


def _composed(v: str) -> str:
    return f"""(CASE WHEN {v} >= 1000 THEN s.total + greatest(s.part, 1L) * {v}
        WHEN {v} = 100 THEN greatest(s.total, 0L) + s.part * 100L ELSE greatest(s.total, 0L) + s.part + {v} END)"""


_CARDINAL_STEP = f"""CASE WHEN {_fits('v')} THEN {_state(
    's.done', 'CASE WHEN v >= 1000 THEN s.total + greatest(s.part, 1L) * v ELSE greatest(s.total, 0L) END',
    'CASE WHEN v >= 1000 THEN 0L WHEN v = 100 THEN s.part * 100L ELSE s.part + v END',
    'CASE WHEN v >= 1000 THEN v ELSE s.scale END')}
    ELSE {_state(_CLOSED, 'CASE WHEN v >= 1000 THEN v ELSE 0L END', 'CASE WHEN v >= 1000 THEN 0L ELSE v END',
                 f'CASE WHEN v >= 1000 THEN v ELSE {_NEW_SCALE} END')} END"""
_V = f"(v - {_ORDINAL}L)"
_ORDINAL_WORDS = "array(" + ", ".join(f"'{w}'" for w, n in ORDINALS.items() if n <= PLAIN_ORDINALS) + ")"
_ORDINAL_STEP = f"""CASE WHEN {_fits(_V)} THEN {_state(f"concat(s.done, array({_ordinal(_composed(_V))}))")}
    ELSE {_state(f"concat({_CLOSED}, array(CASE WHEN {_V} <= {PLAIN_ORDINALS} THEN element_at({_ORDINAL_WORDS}, CAST({_V} AS int)) ELSE {_ordinal(_V)} END))")} END"""
_PART_STEP = _state(f"concat(s.done, array(concat({_NUMBER}, '/', CAST(v - {_PART}L AS string))))")
_STEP = f"""CASE WHEN v = {_POINT}L THEN {_state('s.done', 's.total', 's.part', 's.scale', "''")}
    WHEN s.decimals IS NOT NULL AND v < 10 THEN {_state('s.done', 's.total', 's.part', 's.scale', 'concat(s.decimals, CAST(v AS string))')}
    WHEN v >= {_PART}L THEN {_PART_STEP}
    WHEN v >= {_ORDINAL}L THEN {_ORDINAL_STEP}
    ELSE {_CARDINAL_STEP} END"""
_ALONE = ", ".join(f"'{w}'" for w in ["one", *[w for w, n in ORDINALS.items() if n <= PLAIN_ORDINALS]])


def _converted(run: str) -> str:
    values = f'transform(filter(split(lower({run}), r"{_GAP}"), w -> w <> "and"), w -> {_TABLE}[w])'
    return f"""CASE WHEN lower({run}) IN ({_ALONE}) THEN {run} ELSE aggregate({values}, {_START},
        (s, v) -> {_STEP}, s -> array_join({_CLOSED}, ' ')) END"""


def words_to_digits_sql(text: str) -> str:
    """SQL text expression with its number words as digits."""
    return f"""CASE WHEN regexp_like({text}, r"{RUN}") THEN array_join(zip_with(
        split({text}, r"{RUN}", -1), regexp_extract_all({text}, r"{RUN}", 0),
        (piece, run) -> concat(coalesce(piece, ''), coalesce({_converted('run')}, ''))), '')
        ELSE {text} END"""
