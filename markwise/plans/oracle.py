"""SQL fragments the checking queries are put together from."""

from __future__ import annotations

from markwise import fixed_values as fixed
from markwise.plans import bindings

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
NOT_WORD = r"[^\pL\pN_]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def punct(x: str) -> str:
    dashes = f"regexp_replace({x}, '[\\-=]', ' ', 'g')"
    words = f"replace(replace({dashes}, '%', ' percent '), 'n''t', ' not')"
    return f"regexp_replace({words}, '[()~!^,?.''$]', '', 'g')"


def split(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"


def content(tokens: str) -> str:
    words = ", ".join(lit(w) for w in fixed.STOP_WORDS)
    return f"list_filter({tokens}, lambda w: w NOT IN ({words}))"


def tokens(x: str) -> str:
    """Preprocessing; the given texts hold no number words."""
    mapped = "CASE WHEN w = 'n''t' THEN 'not' ELSE w END"
    return f"list_transform({content(split(punct(f'lower({x})')))}, lambda w: {mapped})"


def negations(tokens_: str) -> str:
    joined = f"regexp_replace(array_to_string({tokens_}, ' '), '[.*'']', '', 'g')"
    spaced = f"' ' || regexp_replace({joined}, '{NOT_WORD}', '  ', 'g') || ' '"
    return f"len(regexp_extract_all({spaced}, ' ({'|'.join(fixed.NEGATION_WORDS)}) '))"


def joined(list_: str) -> str:
    return f"md5(array_to_string({list_}, ' '))"


def hits(text: str, regexes: str) -> str:
    return f"list_transform({regexes}, lambda r: CAST(regexp_matches({text}, r) AS INT))"


def ratio(text: str, regexes: str) -> str:
    return f"CASE WHEN len({regexes}) = 0 THEN 0.0 ELSE list_sum({hits(text, regexes)}) / len({regexes}) END"


def cosine(a: str, b: str) -> str:
    return (
        f"CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 "
        f"THEN list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a})) / sqrt(list_dot_product({b}, {b})) ELSE 0 END"
    )


def _regex_case(table: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN exp_num = '{e}' THEN [{', '.join(lit(r) for r in rx)}]" for e, rx in table.items())
    return f"CASE {cases} END"


LABEL = strip("lower(label)")

RAW = """raw AS (
  SELECT d.lang AS lesson, '0' AS exp_num, d.doc_id AS row_id, d.text,
    CASE WHEN quality = 1 AND toxic = 1 THEN ' GOOD ' WHEN quality = 1 THEN 'Good'
         WHEN toxic = 1 THEN 'unsure' ELSE 'bad' END AS label
  FROM documents d JOIN labels USING (doc_id)
  UNION ALL
  SELECT d.lang, '1', d.doc_id, d.text, CASE WHEN toxic = 0 THEN 'good' ELSE 'Bad ' END
  FROM documents d JOIN labels USING (doc_id))"""

EXPECT = f"""expect AS (
  SELECT lesson, exp_num, CAST(exp_num AS INT) AS pos, b.text AS question, ideal,
    {_regex_case(bindings.GOOD_REGEXES)} AS good, {_regex_case(bindings.BAD_REGEXES)} AS bad
  FROM (SELECT lesson, exp_num, text AS ideal,
          row_number() OVER (PARTITION BY lesson, exp_num ORDER BY length(text), row_id) AS n
        FROM raw WHERE {LABEL} = 'good' AND length(text) >= {bindings.IDEAL_MIN_CHARS}) x
  LEFT JOIN benchmark b ON b.item_id = list_position(['de', 'en', 'es', 'fr'], lesson) - 1
  WHERE n = 1)"""

CLEAN = f"""clean AS (
  SELECT lesson, exp_num, row_id, {strip('lower(text)')} AS text, {LABEL} AS label
  FROM raw WHERE {LABEL} IN ('good', 'bad') AND text IS NOT NULL)"""

KEEP = """keep AS (
  SELECT e.lesson, e.exp_num FROM expect e
  JOIN (SELECT lesson, exp_num FROM raw GROUP BY ALL HAVING count(*) >= 10) c USING (lesson, exp_num))"""

ROWS = f"""ordered AS (
  SELECT lesson, exp_num, 1 AS place, row_id, text, label FROM clean SEMI JOIN keep USING (lesson, exp_num)
  UNION ALL
  SELECT lesson, exp_num, 0, -1, {strip('lower(ideal)')}, 'good' FROM expect SEMI JOIN keep USING (lesson, exp_num)
  WHERE length(ideal) > 0)"""

WHOLE = """whole AS (
  SELECT lesson, string_agg(ideal, '' ORDER BY exp_num) AS text FROM expect
  SEMI JOIN ordered USING (lesson, exp_num) GROUP BY lesson),
train AS (
  SELECT * FROM ordered
  UNION ALL
  SELECT o.lesson, o.exp_num, 2, -1, w.text, 'good'
  FROM (SELECT DISTINCT lesson, exp_num FROM ordered) o JOIN whole w USING (lesson))"""

VOCAB = f"""counted AS (
  SELECT DISTINCT w AS word FROM (SELECT unnest({split(punct('lower(text)'))}) AS w FROM documents)),
vocab AS (
  SELECT word, CAST('0x' || substr(md5(word), 8, 2) AS BIGINT) < {bindings.SLIM_PARTS} AS in_slim, CAST(embedding AS DOUBLE[]) AS vector
  FROM counted JOIN embeddings
  ON vec_id = CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) % (SELECT count(*) FROM embeddings))"""

ASKED = """asked AS (
  SELECT conv_id || '-' || turn AS answer_id, (['de', 'en', 'es', 'fr'])[conv_id % 4 + 1] AS lesson,
    CASE WHEN conv_id % 2 = 1 THEN CAST(turn % 3 AS VARCHAR) END AS exp_num, text
  FROM conversations WHERE role = 'user')"""

FANNED = """fanned AS (
  SELECT a.answer_id, a.lesson, e.exp_num, a.text, e.pos, e.question, e.ideal, e.good, e.bad
  FROM asked a JOIN expect e USING (lesson) WHERE a.exp_num IS NULL
  UNION ALL
  SELECT a.answer_id, a.lesson, a.exp_num, a.text, e.pos, e.question, coalesce(e.ideal, ''), e.good, e.bad
  FROM asked a LEFT JOIN expect e USING (lesson, exp_num) WHERE a.exp_num IS NOT NULL)"""


def means(source: str, key: str, tokens_: str, name: str, width: str = "64") -> str:
    """Mean vector per key over distinct known words; zero where none is known."""
    keys = key.split(", ")
    on = " AND ".join(f"t.{k} = m.{k}" for k in keys)
    cols = ", ".join(f"t.{k}" for k in keys)
    return f"""{name}_w AS (SELECT {key}, unnest(list_distinct({tokens_})) AS word FROM {source}),
{name}_d AS (SELECT {key}, i, avg(vector[i]) AS v, count(*) AS n
  FROM (SELECT {key}, vector, unnest(range(1, {width} + 1)) AS i FROM {name}_w JOIN vocab USING (word)) GROUP BY ALL),
{name}_m AS (SELECT {key}, list(v ORDER BY i) AS vector, max(n) AS n FROM {name}_d GROUP BY ALL),
{name} AS (SELECT {cols}, coalesce(m.n, 0) AS n_known,
  coalesce(m.vector, list_transform(range(1, {width} + 1), lambda x: CAST(0 AS DOUBLE))) AS vector
  FROM {source} t LEFT JOIN {name}_m m ON {on})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
