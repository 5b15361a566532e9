"""SQL for DuckDB that says numbers independently of the Column expressions: a table of groups and arithmetic."""

from __future__ import annotations

from loquat.functions.numbers import DIGITS

_D = "[" + ", ".join(f"'{w}'" for w in DIGITS) + "]"

_TENS = f"CASE WHEN t = 0 AND u > 0 AND said THEN 'lẻ' WHEN t = 1 THEN 'mười' WHEN t > 1 THEN {_D}[t + 1] || ' mươi' END"
_ONES = f"CASE WHEN u = 1 AND t > 1 THEN 'mốt' WHEN u = 5 AND t > 0 THEN 'lăm' WHEN u > 0 THEN {_D}[u + 1] END"

#: Two lists of a thousand groups: as the first group of a number, and inside one.
GROUPS = f"""
three AS (SELECT n, n // 100 AS h, n // 10 % 10 AS t, n % 10 AS u FROM (SELECT unnest(range(1000)) AS n)),
first_w AS (SELECT n, concat_ws(' ', CASE WHEN h > 0 THEN {_D}[h + 1] || ' trăm' END, {_TENS}, {_ONES}) AS w FROM (SELECT *, h > 0 AS said FROM three)),
inner_w AS (SELECT n, concat_ws(' ', {_D}[h + 1] || ' trăm', {_TENS}, {_ONES}) AS w FROM (SELECT *, true AS said FROM three)),
said AS (SELECT (SELECT list(w ORDER BY n) FROM first_w) AS a, (SELECT list(w ORDER BY n) FROM inner_w) AS b)
"""


def words(n: str) -> str:
    """Words of a whole number under 10**12; the query must join ``said``."""
    parts = []
    for k, scale in ((3, " tỷ"), (2, " triệu"), (1, " nghìn"), (0, "")):
        unit, value = 1000**k, f"(({n}) // {1000**k} % 1000)"
        parts.append(f"CASE WHEN {value} = 0 THEN NULL WHEN ({n}) < {unit * 1000} THEN said.a[{value} + 1] || '{scale}' ELSE said.b[{value} + 1] || '{scale}' END")
    return f"CASE WHEN ({n}) = 0 THEN '{DIGITS[0]}' ELSE concat_ws(' ', {', '.join(parts)}) END"


def two_digits(n: str) -> str:
    """Words of a text of one or two digits: 0d keeps its zero."""
    return f"CASE WHEN length({n}) = 2 AND {n}[1] = '0' THEN '{DIGITS[0]} ' || {_D}[({n}[2])::INT + 1] ELSE {words(f'({n})::BIGINT')} END"


def clock(n: str) -> str:
    return f"CASE WHEN {n} = '00' THEN '{DIGITS[0]}' ELSE {two_digits(n)} END"


def digits(text: str, name: str = "c") -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda {name}: {_D}[{name}::INT + 1]), ' ')"


def decimals(text: str) -> str:
    """Two decimals as text, the zeros at their end still there."""
    return f"CASE WHEN regexp_matches({text}, '[1-9]5$') THEN {digits(f'{text}[1:1]')} || ' lăm' ELSE {digits(text)} END"


def cut_decimals(text: str) -> str:
    """'' without decimals other than 0, else they, without the zeros at their end."""
    cut = f"rtrim({text}, '0')"
    return f"CASE WHEN {cut} = '' THEN '' WHEN regexp_matches({cut}, '[1-9]5$') THEN {digits(f'{cut}[1:1]')} || ' lăm' ELSE {digits(cut)} END"


def values(rows: list[tuple], columns: str) -> str:
    quote = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS v({columns})"
