"""Rules over texts that are built from columns of the tables, and SQL that says the same from the columns themselves."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.functions.bind import Rule
from loquat.operators import normalize as R

from .sql import GROUPS, clock, cut_decimals, decimals, digits, words


class Built(NamedTuple):
    """A rule over a text made of a table's columns (Spark SQL), and its result from ``columns`` (DuckDB)."""

    table: str
    keys: str
    text: str
    rule: Rule
    columns: str
    said: str


_LINE, _LINES = "l_orderkey, l_linenumber", "l_linenumber AS i, l_quantity::BIGINT AS q"
_QUANTITY = "cast(cast(l_quantity as bigint) as string)"
_PRICE = "round(p_retailprice * 100)::BIGINT // 100 AS w, lpad((round(p_retailprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS r"
_CENTS = "cast(round(p_retailprice * 100) as bigint)"
_MONTH = f"CASE WHEN m = 4 THEN 'tư' ELSE {words('m')} END"
_ORDER = "day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y"

BUILT: dict[str, Built] = {
    "range_words": Built("lineitem", _LINE, "concat(l_linenumber, '-', l_linenumber + cast(l_quantity as bigint))", R.number_range, "l_linenumber::VARCHAR AS i, (l_linenumber + l_quantity::BIGINT)::VARCHAR AS j", "CASE WHEN abs(length(i) - length(j)) <= 1 THEN ' ' || i || ' đến ' || j || ' ' ELSE ' ' || i || ' ' || j || ' ' END"),
    "context_range_words": Built("lineitem", _LINE, f"concat('từ ', l_linenumber, ' - ', {_QUANTITY})", R.context_minus, _LINES, "' từ ' || i || ' đến ' || q || ' '"),
    "version_words": Built("lineitem", _LINE, f"concat(l_orderkey, '.', l_linenumber, '.', {_QUANTITY})", R.versions, _LINES + ", l_orderkey AS k", f"{digits('k::VARCHAR')} || ' chấm ' || {digits('i::VARCHAR', 'x')} || ' chấm ' || {digits('q::VARCHAR', 'y')}"),
    "comma_list_words": Built("lineitem", _LINE, f"concat(l_linenumber, ',', {_QUANTITY}, ',', l_linenumber)", R.many_commas, "l_linenumber::VARCHAR AS i, l_quantity::BIGINT::VARCHAR AS q", f"{digits('i')} || ' phẩy ' || {decimals('q')} || ' phẩy ' || {digits('i', 'x')}"),
    "arrow_words": Built("lineitem", _LINE, f"concat(l_linenumber, '  -> ', {_QUANTITY})", R.dashes_and_arrows, _LINES, "i || ' sang ' || q"),
    "month_year_words": Built("orders", "o_orderkey", "date_format(o_orderdate, 'MM/yyyy')", R.month_year, _ORDER, f"'tháng ' || {_MONTH} || ' năm ' || {words('y')}"),
    "day_month_words": Built("orders", "o_orderkey", "date_format(o_orderdate, 'dd-MM')", R.day_month, _ORDER, f"'ngày ' || {words('d')} || ' tháng ' || {_MONTH}"),
    "negative_words": Built("orders", "o_orderkey", "concat('-', o_orderkey)", R.numbers, "o_orderkey AS n", f"' âm ' || {words('n')} || ' '"),
    "thousands_digits": Built("orders", "o_orderkey", "concat(replace(format_number(o_orderkey, 0), ',', '.'), ' đồng')", R.dotted_thousands, "o_orderkey AS n", "n || ' đồng'"),
    "english_number_digits": Built("orders", "o_orderkey", "format_number(1000 + o_orderkey + 0.25, 2)", R.english_numbers, "o_orderkey AS n", "(1000 + n) || ',25'"),
    "name_words": Built("orders", "o_orderkey", "concat('TP.HCM ', o_orderkey)", R.exceptions, "o_orderkey AS n", "'thành phố hồ chí minh ' || n"),
    "clock_words": Built("events", "event_id", "date_format(ts, 'HH:mm')", R.clock_time, "strftime(ts, '%H') AS h, strftime(ts, '%M') AS m", f"{clock('h')} || ' giờ ' || {clock('m')} || ' phút'"),
    "hour_words": Built("events", "event_id", "concat('lúc ', hour(ts), 'g')", R.hours, "hour(ts) AS h", f"'lúc ' || {words('h')} || ' giờ'"),
    "measured_words": Built("part", "p_partkey", "concat(p_size, ' kg')", R.measured, "p_size AS n", f"{words('n')} || ' ki lô gam'"),
    "speed_words": Built("part", "p_partkey", "concat(p_size, 'km/h')", R.compound_units, "p_size AS n", f"{words('n')} || '  ki lô mét trên giờ '"),
    "yen_words": Built("part", "p_partkey", "concat(p_partkey, '¥')", R.suffix_currency, "p_partkey AS n", f"{words('n')} || ' yên'"),
    "scientific_words": Built("part", "p_partkey", "concat(p_size, 'e-', p_size % 7)", R.scientific_notation, "p_size AS n", f"{words('n')} || ' nhân mười mũ trừ ' || {words('(n % 7)')}"),
    "explicit_power_words": Built("part", "p_partkey", "concat(p_size, ' x 10^', p_size % 9)", R.explicit_power, "p_size AS n", f"' ' || n || ' nhân mười mũ ' || {words('(n % 9)')} || ' '"),
    "implicit_power_words": Built("part", "p_partkey", "concat('10^', p_size)", R.implicit_power, "p_size AS n", f"'mười mũ ' || {words('n')}"),
    "unit_power_words": Built("part", "p_partkey", "concat('m^-', p_size)", R.unit_powers, "p_size AS n", f"' mét mũ trừ ' || {words('n')} || ' '"),
    "comma_number_words": Built("part", "p_partkey", f"concat({_CENTS} div 100, ',', lpad({_CENTS} % 100, 2, '0'))", R.comma_numbers, _PRICE, f"CASE WHEN {cut_decimals('r')} = '' THEN ' ' || {words('w')} || ' ' ELSE ' ' || {words('w')} || ' phẩy ' || {cut_decimals('r')} || ' ' END"),
    "ratio_words": Built("part", "p_partkey", "concat(p_partkey, ':', p_size)", R.colon_numbers, "p_partkey AS k, p_size AS n", f"' ' || {words('k')} || ' hai chấm ' || {words('n')} || ' '"),
    "product_words": Built("part", "p_partkey", "concat(p_partkey, ' x ', p_size)", R.products, "p_partkey AS k, p_size AS n", f"{words('k')} || ' nhân ' || {words('n')}"),
    "house_letter_words": Built("part", "p_partkey", "concat(p_size, 'B')", R.digits_letter, "p_size AS n", "n || ' bê'"),
    "temperature_words": Built("part", "p_partkey", "concat('-', p_size, ' °C')", R.brackets_and_degrees, "p_size AS n", "'âm ' || n || ' độ xê'"),
    "bracket_words": Built("part", "p_partkey", "concat('a ( ', p_size, ' ) b (', p_partkey)", R.brackets_and_degrees, "p_size AS n, p_partkey AS k", "'a , ' || n || ',  b  ' || k"),
    "symbol_words": Built("part", "p_partkey", "concat(p_size, '+', p_partkey, '≥', p_size)", R.quotes_and_symbols, "p_size AS n, p_partkey AS k", "n || ' cộng ' || k || ' lớn hơn hoặc bằng ' || n"),
    "slash_words": Built("customer", "c_custkey", "concat(c_custkey, '/', c_nationkey)", R.slashes, "c_custkey AS k, c_nationkey AS n", f"{words('k')} || CASE WHEN k > 31 THEN ' xẹt ' ELSE ' trên ' END || {words('n')}"),
    "phone_words": Built("customer", "c_custkey", "concat('09', lpad(c_custkey, 8, '0'))", R.phones, "'09' || lpad(c_custkey::VARCHAR, 8, '0') AS p", digits("p")),
    "dashed_phone_words": Built("customer", "c_custkey", "concat('090-', lpad(c_custkey % 1000, 3, '0'), '-', lpad(c_custkey % 10000, 4, '0'))", R.dashed_phone, "'090' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS p", f"' ' || {digits('p')} || ' '"),
    "suffix_words": Built("customer", "c_custkey", "concat('shop', c_custkey, '.net')", R.suffixes, "c_custkey AS k", "'shop' || k || ' chấm nét'"),
    "ordinal_words": Built("customer", "c_custkey", "concat('thứ ', c_nationkey)", R.ordinals, "c_nationkey AS n", f"'thứ ' || CASE n WHEN 1 THEN 'nhất' WHEN 4 THEN 'tư' ELSE {words('n')} END"),
    "double_words": Built("customer", "c_custkey", "concat('ngày  ngày ', c_custkey)", R.no_double_words, "c_custkey AS k", "'ngày ' || k"),
    "inner_dot_words": Built("customer", "c_custkey", "concat(c_custkey, '.', c_nationkey)", R.inner_dots, "c_custkey AS k, c_nationkey AS n", "k || ' chấm ' || n"),
    "known_characters_docs": Built("documents", "doc_id", "concat(doc_id, ': § 漢; ', doc_id)", R.only_known_characters, "doc_id AS k", "k || ',    , ' || k"),
    "abbreviations_docs": Built("documents", "doc_id", "concat(text, ' v.v đ/c')", R.abbreviations, "text", "replace(replace(replace(text || ' v.v đ/c', 'v.v', ' vân vân'), 'v/v', ' về việc'), 'đ/c', 'địa chỉ')"),
}


def _query(built: Built, read: Callable[[SparkSession, str, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = built.keys.split(", ")
        rows = read(spark, sf_dir, built.table).select(*keys, F.expr(built.text).alias("t"))
        return rows.select(*keys, built.rule(F.col("t")).alias("words"))

    return run


def queries(read: Callable[[SparkSession, str, str], DataFrame]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(built, read) for name, built in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {GROUPS}, p AS (SELECT {b.keys}, {b.columns} FROM {b.table}) SELECT {b.keys}, {b.said} AS words FROM p, said" for name, b in BUILT.items()}
