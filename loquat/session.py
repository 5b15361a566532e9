"""Rules, number words and tokens as temporary SQL functions of a session.

    register_functions(spark)
    spark.sql("SELECT loquat_full_date(text) FROM notes")
    spark.sql("SELECT doc_id, t.* FROM documents, LATERAL loquat_tokens(text) t")

A function's body is the Column expression that the DataFrame API uses, as Spark prints it, so both have one plan: no UDF,
no shuffle, and a table function that generates rows beside the scan. An argument is evaluated once for each row.

Defined cases: a null argument gives null, of the table functions no rows, as an empty text does; functions of these
names that the session has already are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loquat.functions import numbers as N
from loquat.operators import normalize as R
from loquat.operators.g2p import tokens

_ARGUMENT = "text"
#: Functions of one string that give a string: the rules by their own names, what stands around them, and numbers.
SCALARS: dict[str, Callable[[Column], Column]] = {rule.__name__: rule for rule in [R.compose, R.ascii_digits, *R.RULES, R.email, R.technical, R.single_letters, R.inner_dots, R.tidy]} | {
    "number_words": N.n2w,
    "digit_words": N.n2w_single,
    "quantity_words": N.quantity,
}
#: Functions of one string that give rows: columns, what is selected, and what is generated.
TABLES: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "tokens": ("position INT, word STRING, tagged BOOLEAN", "pos, col.word, col.tagged", tokens),
}
_LITERAL_OR_OPERATOR = re.compile(r"('(?:[^'\\]|\\.)*')|(<=>|<=|>=|[=<>!+*/%-]|\b(?:and|or|not)\b)(?=\()", re.S)


def as_sql(column: Column) -> str:
    """A column as SQL that Spark reads: it prints operators as functions, whose names need quotes."""
    printed = re.fullmatch(r"Column<'(.*)'>", str(column), re.S)[1]
    return _LITERAL_OR_OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`", printed)


def register_functions(spark: SparkSession, names: Iterable[str] | None = None, prefix: str = "loquat_") -> list[str]:
    """Make the functions of these names (of all, some sixty, if there are none: about half a minute); return what SQL calls them."""
    made = []
    for name in dict.fromkeys(names if names is not None else [*SCALARS, *TABLES]):
        if name in SCALARS:
            returns, body = "STRING", as_sql(SCALARS[name](F.col(_ARGUMENT)))
        elif name in TABLES:
            columns, selected, rows = TABLES[name]
            returns, body = f"TABLE({columns})", f"SELECT {selected} FROM (SELECT posexplode({as_sql(rows(F.col(_ARGUMENT)))}))"
        else:
            raise ValueError(f"no function is called {name!r}; there are {', '.join([*SCALARS, *TABLES])}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({_ARGUMENT} STRING) RETURNS {returns} RETURN {body}")
        made.append(prefix + name)
    return made
