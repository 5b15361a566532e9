"""Queries that write a lexicon of the documents' words as a file and read it back: whole, by filter and by search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.operators.g2p import tokens
from loquat.sources import lexicon as L
from loquat.sources.pooled import search_lexicon
from loquat.sources.shared import shared_path

Table = Callable[[SparkSession, str, str], DataFrame]


def _words(texts: DataFrame, *keep: str) -> DataFrame:
    words = texts.select(*keep, F.explode(F.transform(tokens(F.col("text")), lambda t: F.lower(t["word"]))).alias("word"))
    return words.filter(F.col("word").rlike(r"(?U)^\w"))


def _saved(spark: SparkSession, documents: DataFrame) -> str:
    """Words of several languages are common; each word's "phonemes" tell how often it is there."""
    words = _words(documents, "lang").groupBy("word").agg(F.count_distinct("lang").alias("k"), F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("lang") == "en"), F.lit(False)).alias("english"))
    one, n = F.col("k") <= 1, F.col("n").cast("string")
    said = lambda mark, test: F.when(test, F.concat(F.lit(mark), n))
    lexicon = words.select("word", F.when(one, "merged").otherwise("common").alias("kind"), said("n", one).alias("phone"), F.when(one, F.col("english")).alias("is_en"), said("v", ~one).alias("vi_phone"), said("e", ~one).alias("en_phone"))
    path = shared_path(spark, "words.bin")
    L.save_lexicon(lexicon, path)
    return path


def queries(table: Table) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def lexicon_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.load_lexicon(spark, _saved(spark, table(spark, sf_dir, "documents")))

    def lexicon_file_range(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How many words of each kind are on either side of 'n'; the greater ones are read through a pushed filter."""
        words = L.load_lexicon(spark, _saved(spark, table(spark, sf_dir, "documents")))
        sides = words.filter("word >= 'n'").withColumn("side", F.lit("from n")).unionByName(words.filter("word < 'n'").withColumn("side", F.lit("to n")))
        return sides.groupBy("side", "kind").agg(F.count("*").alias("n_words"), F.min("word").alias("first"), F.max("word").alias("last"))

    def lexicon_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The words of conversations, looked up in a file of the documents' words."""
        return search_lexicon(_words(table(spark, sf_dir, "conversations")), _saved(spark, table(spark, sf_dir, "documents")))

    return {q.__name__: q for q in (lexicon_file_scan, lexicon_file_range, lexicon_file_search)}


def oracle_sql(token: str, word: str) -> dict[str, str]:
    """``token`` and ``word`` are patterns of a token and of a letter in one."""
    found = f"lower(unnest(regexp_extract_all(text, '{token}'))) AS word"
    file = f"""
    WITH w AS (SELECT lang, {found} FROM documents),
    g AS (SELECT word, count(DISTINCT lang) AS k, count(*)::VARCHAR AS n, coalesce(bool_or(lang = 'en'), false) AS english FROM w WHERE regexp_matches(word, '^{word}') GROUP BY word),
    file AS (SELECT word, CASE WHEN k <= 1 THEN 'merged' ELSE 'common' END AS kind, CASE WHEN k <= 1 THEN 'n' || n END AS phone, CASE WHEN k <= 1 THEN english END AS is_en,
                    CASE WHEN k > 1 THEN 'v' || n END AS vi_phone, CASE WHEN k > 1 THEN 'e' || n END AS en_phone FROM g)"""
    return {
        "lexicon_file_scan": f"{file} SELECT * FROM file",
        "lexicon_file_range": f"{file} SELECT CASE WHEN word >= 'n' THEN 'from n' ELSE 'to n' END AS side, kind, count(*) AS n_words, min(word) AS first, max(word) AS last FROM file GROUP BY 1, 2",
        "lexicon_file_search": f"{file} SELECT * FROM file WHERE word IN (SELECT {found} FROM conversations)",
    }
