"""Queries in Spark SQL that call the functions of a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loquat.session import register_functions

from .sql import GROUPS, words

Table = Callable[[SparkSession, str, str], DataFrame]

_DATE = "date_format(o_orderdate, 'dd/MM/yyyy')"
#: Query: the table it reads, the functions it calls, and its text.
TEXTS: dict[str, tuple[str, list[str], str]] = {
    "sql_word_counts": ("documents", ["tokens"], "SELECT lower(t.word) AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM {documents}, LATERAL loquat_tokens(text) t GROUP BY lower(t.word)"),
    "sql_tokens_docs": ("documents", ["tokens"], "SELECT doc_id, t.position, t.word FROM {documents}, LATERAL loquat_tokens(text) t WHERE t.word RLIKE '^[0-9]+$'"),
    "sql_clean_docs": ("documents", ["tidy", "number_words"], "SELECT doc_id, loquat_tidy(text) AS clean, loquat_number_words(doc_id) AS id_words FROM {documents}"),
    "sql_late_orders": ("orders", ["full_date", "number_words"], f"SELECT loquat_full_date({_DATE}) AS words, loquat_number_words(count(*)) AS orders FROM {{orders}} WHERE loquat_full_date({_DATE}) LIKE '%tháng mười hai%' GROUP BY loquat_full_date({_DATE})"),
}


def queries(table: Table) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def made(name: str, source: str, functions: list[str], text: str) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register_functions(spark, functions)
            return spark.sql(text, **{source: table(spark, sf_dir, source)})

        run.__name__ = name
        return run

    return {name: made(name, *parts) for name, parts in TEXTS.items()}


def oracle_sql(token: str, tidy: Callable[[str], str]) -> dict[str, str]:
    """SQL for DuckDB; ``token`` is its pattern of a token, ``tidy`` its clean text."""
    found = f"SELECT doc_id, regexp_extract_all(text, '{token}') AS t FROM documents"
    date = f"'ngày ' || {words('d')} || ' tháng mười hai năm ' || {words('y')}"
    return {
        "sql_word_counts": f"SELECT lower(w) AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(t) AS w FROM ({found})) GROUP BY 1",
        "sql_tokens_docs": f"SELECT * FROM (SELECT doc_id, (unnest(range(len(t))))::INTEGER AS position, unnest(t) AS word FROM ({found})) WHERE regexp_full_match(word, '[0-9]+')",
        "sql_clean_docs": f"WITH {GROUPS} SELECT doc_id, {tidy('text')} AS clean, {words('doc_id')} AS id_words FROM documents, said",
        "sql_late_orders": f"WITH {GROUPS}, days AS (SELECT day(o_orderdate) AS d, year(o_orderdate) AS y, count(*) AS n FROM orders WHERE month(o_orderdate) = 12 GROUP BY 1, 2) SELECT {date} AS words, {words('n')} AS orders FROM days, said",
    }
