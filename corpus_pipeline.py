"""A training-corpus pipeline over ``documents``, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before kept, and its result is written
as Parquet and read again. All but the last return the columns of ``documents``.

1. ``quality_classifier``: documents that the classifier rejects go; it learns from ``labels`` (never from rows held
   out) and rejects below ``REJECT``, as clean documents matter more here than the last bit of noise.
2. ``line_dedup``: lines of templates that recur across documents are cut; the document stays.
3. ``ngram_jaccard_join``: of each group of near-duplicates (five-word shingles, 0.8) the row with the smallest doc_id
   stays (of equal ids, the smaller digest of the text; rows without id come last; of equal rows one stays).
4. ``benchmark_decontamination``: documents that leak a benchmark item go.
5. ``packing``: a row per piece of the remaining documents, with its place in a window.

``n_chars`` follows the text. Defined cases: each row is judged by its own text, also where ids are null or repeat; null
and empty texts pass the third and fourth stage (they link with nothing and leak nothing) and get one token in the fifth;
a very long text is one row's work in each stage; further columns of ``documents``, whatever their names, are passed on
by all stages but the last; every stage works on an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from loquat.llm.common import Stage, bounded, numbered, table

REJECT = 0.5


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (_doc, _row) but those whose _doc is in ``gone`` (staged)."""
    return rows.join(bounded(gone), "_doc", "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.scored_rows(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("_score") >= REJECT).select("_row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dropped_lines(docs)
    chars = F.when(F.col("n_dropped") > 0, F.length("_kept").cast("long")).otherwise(F.col("_row.n_chars"))
    return kept.select(*(F.col("_kept").alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "copies")
    rows = numbered(docs, "doc_id", "text", stage, nulls_first=False)
    linked = jaccard_join.link_documents(rows.select("_doc", "_row.text"), "_doc", size=5, num=80, den=100)
    copies = linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("_doc")).distinct()
    kept = _without(rows, stage.write(copies, "copies"))
    again = stage.write(rows.groupBy("_doc").count().filter("count > 1").select("_doc"), "again")
    if again.limit(1).count():  # equal rows
        kept = _without(kept, again).unionByName(kept.join(bounded(again), "_doc", "left_semi").dropDuplicates(["_doc"]))
    return kept.select("_row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "leaking")
    rows = numbered(docs, "doc_id", "text", stage, nulls_first=False)
    leaks = decontaminate.find_leaks(rows.select("_doc", "_row.text"), table(spark, sf_dir, "benchmark"), "_doc")
    return _without(rows, stage.write(leaks.select(F.col("doc_id").alias("_doc")).distinct(), "leaking")).select("_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]

#: SQL cannot express the learned stages, nor the tokenizer; tests/llm/test_pipeline.py checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = stage.write(step(spark, docs, sf_dir), name)
        if k:
            stage.drop(STAGES[k - 1][0])
    return docs
