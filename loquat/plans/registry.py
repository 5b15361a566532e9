"""Named queries over the driver's tables and the golden fixtures, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.functions import dates
from loquat.functions import numbers as N
from loquat.functions import patterns as P
from loquat.operators import normalize as R
from loquat.operators.g2p import phonemize, tokens
from loquat.operators.pipeline import text_to_phonemes
from loquat.sources import lexicon as L

from . import built, cases, files, in_sql, sql

Query = Callable[[SparkSession, str], DataFrame]


#: Bytes of a split, at most.
SPLIT_BYTES = 128 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Spelling costs far more than moving text, so one with less than a split for each core is dealt out anew; larger ones are read as they are split."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(4 * cores) if size < cores * SPLIT_BYTES else df


def _squeezed(text):
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


# ---- typed columns --------------------------------------------------------


def n2w_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.n2w(F.col("o_orderkey").cast("string")).alias("words"))


def n2w_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", N.n2w_single(F.col("c_custkey").cast("string")).alias("words"))


def decimal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.plain_number(dates.fixed_text(F.col("o_totalprice")), F.lit(False)).alias("words"))


def quantity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", N.quantity(dates.fixed_text(F.col("p_retailprice"))).alias("words"))


def date_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", dates.date_text(F.col("o_orderdate")).alias("t"))
    return rows.select("o_orderkey", R.full_date(F.col("t")).alias("words"))


def time_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", dates.time_text(F.col("ts")).alias("t"))
    return rows.select("event_id", R.full_time(F.col("t")).alias("words"))


def money_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("$"), dates.fixed_text(F.col("l_extendedprice")))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))
    return rows.select("l_orderkey", "l_linenumber", R.prefix_currency(F.col("t")).alias("words"))


def percent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%"))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))
    return rows.select("l_orderkey", "l_linenumber", R.percent(F.col("t")).alias("words"))


# ---- texts ----------------------------------------------------------------


def cleanup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", R.tidy(F.col("text")).alias("clean"))


def email_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(P.EMAIL), F.lit(2))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, " ").alias("emails"), F.size(found).cast("long").alias("n"))


def ip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"), F.lit(0)))
    rows = _table(spark, sf_dir, "documents").select("doc_id", found.alias("ip"))
    return rows.select("doc_id", "ip", R.versions(F.col("ip")).alias("words"))


def acronym_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", R.acronyms(F.col("text")).alias("t"))
    return rows.select("doc_id", ((F.length("t") - F.length(F.replace("t", F.lit("__start_en__"), F.lit("")))) / 12).cast("long").alias("spelled"))


def tokens_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.transform(tokens(F.col("text")), lambda t: t["word"]).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def tokens_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(tokens(F.col("text")), lambda t: t["word"]).alias("t"))
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def lexicon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select("lang", F.explode(F.transform(tokens(F.col("text")), lambda t: F.lower(t["word"]))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    known = counted.join(F.broadcast(L.seed_lexicon(spark).select("word", F.lit(1).alias("known"))), "word", "left")
    return known.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("n_known"), F.count("*").alias("n_words"))


def url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.normalize(_table(spark, sf_dir, "pages").select("page_id", "url"), "url", "words").select("page_id", "words")


def normalize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.normalize(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "normalized")


def phonemize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phonemize(_table(spark, sf_dir, "documents"), L.seed_lexicon(spark), id_col="doc_id")


def phonemize_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal inputs each have their output: the rows of every conversation twice."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "text")
    said = phonemize(rows.unionAll(rows), L.seed_lexicon(spark), id_col="conv_id")
    return said.groupBy("conv_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("phonemes") == "").alias("n_silent"))


def pipeline_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_to_phonemes(_table(spark, sf_dir, "documents"), L.seed_lexicon(spark), id_col="doc_id")


# ---- golden fixtures ------------------------------------------------------


def normalize_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c, s, t) for c, s, t, _ in L.fixture("normalize_golden")], "case_id int, section string, text string")
    return R.normalize(rows).select("case_id", "section", _squeezed(F.col("normalized")).alias("normalized"))


def phonemize_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c, t) for c, t, _ in L.fixture("phonemize_golden")], "case_id int, text string")
    said = phonemize(rows, L.seed_lexicon(spark), id_col="case_id")
    return said.select("case_id", F.trim(F.regexp_replace("phonemes", r"\s+", " ")).alias("phonemes"))


def propagation_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain and the tagged text of a pair must sound alike."""
    rows = spark.createDataFrame([(k, side, t) for k, pair in enumerate(cases.PROPAGATION) for side, t in enumerate(pair)], "pair int, side int, text string")
    keyed = rows.withColumn("id", F.col("pair") * 2 + F.col("side"))
    said = phonemize(keyed, spark.createDataFrame(cases.SMALL_LEXICON, L.SCHEMA)).select(F.floor(F.col("id") / 2).cast("int").alias("pair"), "phonemes")
    return said.groupBy("pair").agg((F.count_distinct("phonemes") == 1).alias("alike"))


def segment_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases.SEGMENTS)], "case_id int, text string")
    return phonemize(rows, spark.createDataFrame(cases.SMALL_LEXICON, L.SCHEMA), id_col="case_id")


def pipeline_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases.PIPELINE)], "case_id int, text string")
    said = text_to_phonemes(rows, L.seed_lexicon(spark), id_col="case_id")
    parts = spark.createDataFrame([(k, p) for k, (_, ps) in enumerate(cases.PIPELINE) for p in ps], "case_id int, part string")
    return parts.join(said, "case_id").select("case_id", "part", F.col("phonemes").contains(F.col("part")).alias("found"))


def _rule_query(name: str, rule, inputs: list[tuple[str, str]]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(inputs)], "case_id int, text string")
        return rows.select("case_id", rule(F.col("text")).alias("said"))

    run.__name__ = name
    return run


_TABLE_QUERIES: list[Query] = [
    n2w_orders, n2w_digits, decimal_words, quantity_words, date_words, time_words, money_words, percent_words,
    cleanup_docs, email_docs, ip_words, acronym_docs, tokens_docs, tokens_conversations, lexicon_coverage,
    url_words, normalize_docs, phonemize_docs, phonemize_repeated, pipeline_docs,
    normalize_golden, phonemize_golden, propagation_golden, segment_golden, pipeline_golden,
]


def queries() -> dict[str, Query]:
    found = {q.__name__: q for q in _TABLE_QUERIES} | built.queries(_table) | files.queries(_table) | in_sql.queries(_table)
    for name, (rule, inputs) in cases.RULES.items():
        found[f"rule_{name}"] = _rule_query(name, rule, inputs)
    return found


_CENTS = "round({0} * 100)::BIGINT"
_WHOLE, _REST = "({0} // 100)", "lpad(({0} % 100)::VARCHAR, 2, '0')"
_WORD = "[\\p{L}\\p{M}\\p{N}_]"
_TOKEN = f"(?i)<en>.*?</en>|{_WORD}+(?:[''’]{_WORD}+)*|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}_]"


def _tidy_sql(text: str) -> str:
    steps = [(r"[ \t\x{00A0}]+", " "), (r",\s*,", ","), (r",\s*([.!?;])", r"\1"), (r"\s+([,.!?;:])", r"\1"), (r"([.,!?;:])([^\s\d<])", r"\1 \2"), (r"([.,!?;:])([^\s\d<])", r"\1 \2"), (r"^\s+|\s+$", "")]
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"trim({text}, ',')"


def _priced(table: str, key: str, column: str, words: str) -> str:
    return f"WITH {sql.GROUPS}, c AS (SELECT {key}, {_CENTS.format(column)} AS n FROM {table}), p AS (SELECT {key}, {_WHOLE.format('n')} AS w, {_REST.format('n')} AS r FROM c) SELECT {key}, {words} AS words FROM p, said"


def oracle_sql() -> dict[str, str]:
    date = "ngày ' || {0} || ' tháng ' || CASE WHEN m = 4 THEN 'tư' ELSE {1} END || ' năm ' || {2}"
    cut = sql.cut_decimals("r")
    point = f"CASE WHEN {cut} = '' THEN '' ELSE ' chấm ' || {cut} END"
    golden = L.fixture("normalize_golden")
    squeeze = lambda x: " ".join(x.split()).lower()
    found = {
        "n2w_orders": f"WITH {sql.GROUPS} SELECT o_orderkey, {sql.words('o_orderkey')} AS words FROM orders, said",
        "n2w_digits": f"SELECT c_custkey, {sql.digits('c_custkey::VARCHAR')} AS words FROM customer",
        "decimal_words": _priced("orders", "o_orderkey", "o_totalprice", f"{sql.words('w')} || ' chấm ' || {sql.decimals('r')}"),
        "quantity_words": _priced("part", "p_partkey", "p_retailprice", f"{sql.words('w')} || {point}"),
        "money_words": _priced("lineitem", "l_orderkey, l_linenumber", "l_extendedprice", f"{sql.words('w')} || {point} || ' __start_en__u s d__end_en__'"),
        "percent_words": f"WITH {sql.GROUPS}, p AS (SELECT l_orderkey, l_linenumber, round(l_discount * 100)::BIGINT AS n FROM lineitem) SELECT l_orderkey, l_linenumber, {sql.words('n')} || ' phần trăm' AS words FROM p, said",
        "date_words": f"WITH {sql.GROUPS}, p AS (SELECT o_orderkey, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders) SELECT o_orderkey, '{date.format(sql.words('d'), sql.words('m'), sql.words('y'))} AS words FROM p, said",
        "time_words": f"WITH {sql.GROUPS}, p AS (SELECT event_id, strftime(ts, '%H') AS h, strftime(ts, '%M') AS m, strftime(ts, '%S') AS s FROM events) SELECT event_id, {sql.clock('h')} || ' giờ ' || {sql.clock('m')} || ' phút ' || {sql.clock('s')} || ' giây' AS words FROM p, said",
        "cleanup_docs": f"SELECT doc_id, {_tidy_sql('text')} AS clean FROM documents",
        "email_docs": "SELECT doc_id, array_to_string(e, ' ') AS emails, len(e)::BIGINT AS n FROM (SELECT doc_id, regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b') AS e FROM documents)",
        "ip_words": f"SELECT doc_id, ip, array_to_string(list_transform(string_split(ip, '.'), lambda p: {sql.digits('p', 'd')}), ' chấm ') AS words FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[0-9.]+'), lambda w: regexp_full_match(w, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}'))) AS ip FROM documents)",
        "acronym_docs": f"WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+(\\s+|$)')) AS s FROM documents), n AS (SELECT doc_id, sum(CASE WHEN regexp_matches(s, '\\p{{L}}') AND NOT regexp_matches(s, '\\p{{Ll}}') THEN 0 ELSE len(list_filter(regexp_extract_all(s, '{_WORD}+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) END) AS n FROM s GROUP BY doc_id) SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0)::BIGINT END AS spelled FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id",
        "phonemize_repeated": "SELECT conv_id, 2 * count(*) AS n_rows, (2 * count(*) FILTER (WHERE text IS NULL OR NOT regexp_matches(text, '[^\\s]')))::BIGINT AS n_silent FROM conversations GROUP BY conv_id",
        "tokens_docs": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS t FROM documents)",
        "tokens_conversations": f"SELECT conv_id, turn, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT conv_id, turn, regexp_extract_all(text, '{_TOKEN}') AS t FROM conversations)",
        "lexicon_coverage": f"WITH w AS (SELECT lang, lower(unnest(regexp_extract_all(text, '{_TOKEN}'))) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2), k AS (SELECT * FROM {sql.values([(r[0],) for r in L.seed_rows()], 'known')}) SELECT lang, sum(n)::BIGINT AS n_tokens, sum(CASE WHEN known IS NULL THEN 0 ELSE n END)::BIGINT AS n_known, count(*) AS n_words FROM c LEFT JOIN k ON word = known GROUP BY lang",
        "normalize_golden": f"SELECT * FROM {sql.values([(c, s, squeeze(e)) for c, s, _, e in golden], 'case_id, section, normalized')}",
        "phonemize_golden": f"SELECT * FROM {sql.values([(c, ' '.join(e.split())) for c, _, e in L.fixture('phonemize_golden')], 'case_id, phonemes')}",
        "propagation_golden": f"SELECT * FROM {sql.values([(k, True) for k in range(len(cases.PROPAGATION))], 'pair, alike')}",
        "segment_golden": f"SELECT * FROM {sql.values([(k, e) for k, (_, e) in enumerate(cases.SEGMENTS)], 'case_id, phonemes')}",
        "pipeline_golden": f"SELECT * FROM {sql.values([(k, p, True) for k, (_, ps) in enumerate(cases.PIPELINE) for p in ps], 'case_id, part, found')}",
    }
    found |= built.oracle_sql() | files.oracle_sql(_TOKEN, _WORD) | in_sql.oracle_sql(_TOKEN, _tidy_sql)
    for name, (_, inputs) in cases.RULES.items():
        found[f"rule_{name}"] = f"SELECT * FROM {sql.values([(k, e) for k, (_, e) in enumerate(inputs)], 'case_id, said')}"
    return found
