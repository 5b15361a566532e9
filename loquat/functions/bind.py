"""Combinators for rewriting text with Column expressions.

A rewrite with a computed replacement is expressed without a UDF: the text is split at the pattern, the groups of
every match are extracted, and gaps and rendered matches are woven together. ``let`` names an intermediate text, so
that an expression which reads it several times is evaluated once and the plan stays linear in the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules bound inside one column: the analyzer's work grows with the depth of what it looks at.
RULES_A_COLUMN = 3
_ENTRY, _PAIR = "❘", "❙"


_made: dict[tuple, Column] = {}


def once(key: tuple, make: Callable[[], Column]) -> Column:
    """An expression made once for each JVM: expressions can't change, and making them costs many calls to it."""
    key = (id(SparkContext._active_spark_context), *key)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def lit(text: str) -> Column:
    return once(("lit", text), lambda: F.lit(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), lit(1))


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of ``key``, or null. The table is one literal, folded to a map when the query is planned."""
    text = _ENTRY.join(f"{k}{_PAIR}{v}" for k, v in table.items())
    return F.element_at(once(("map", text), lambda: F.str_to_map(F.lit(text), F.lit(_ENTRY), F.lit(_PAIR))), key)


def nth(values: list[str], index: Column) -> Column:
    """The value at a place (from 0) of a fixed list, a literal like the table of ``lookup``."""
    text = _ENTRY.join(values)
    return F.get(once(("list", text), lambda: F.split(F.lit(text), _ENTRY)), index)


def rewrite(text: Column, pattern: str, groups: tuple[int, ...], render: Callable[..., Column]) -> Column:
    """``text`` with each match replaced by ``render(*groups)``; texts without a match are passed on after one test.

    ``text`` should be a name (a column or what ``let`` binds), as it is read once for each group. Matches must
    not be empty; a group that takes no part is ''.
    """
    found = F.arrays_zip(*(F.regexp_extract_all(text, lit(pattern), lit(k)) for k in groups))
    woven = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.when(m.isNull(), gap).otherwise(F.concat(gap, render(*(m.getField(str(k)) for k in range(len(groups)))))))
    return F.when(text.rlike(pattern), F.array_join(woven, "")).otherwise(text)


def replace(text: Column, pattern: str, template: str) -> Column:
    return F.regexp_replace(text, pattern, template)


def spaced(text: Column) -> Column:
    """The characters, a blank between them."""
    return F.regexp_replace(text, "(?s)(.)(?=.)", "$1 ")


Rule = Callable[[Column], Column]


def chain(rules: list[Rule], text: Column) -> Column:
    """The rules one after another, each reading a bound name."""
    out = rules[0](text)
    for rule in rules[1:]:
        out = let(out, rule)
    return out
