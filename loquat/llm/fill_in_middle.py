"""Fill-in-middle: documents cut into prefix, middle and suffix, put together in the order that a model is trained on.

A text is cut into n units, each a word with the blanks before it (or the blanks at the end). Two hashed numbers name the
places of the cuts, a third whether the document is transformed at all, a fourth the order of its parts: ``psm`` is
``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``, ``plain`` the text as it is. The numbers are
the first four groups of eight digits of the hex SHA-256 of ``seed:id``, so a document has one form wherever and whenever
it is read; nothing is shuffled, and a lost task gives the same rows again.

The work is done by DuckDB inside ``mapInArrow``: some documents at a time (``CHUNK_BYTES`` of text; a longer document
by itself) are registered as an Arrow table, one SQL statement cuts, hashes and joins them, and Arrow comes back. No row
passes through Python. A connection has one thread and lives as long as its task.

A text that holds a sentinel stays plain; so in a transformed one each sentinel occurs once, and ``restored`` finds the
parts again by Column expressions.

Defined cases: null text is empty, and empty text is plain with n = 0; a null id is hashed as no digits, ids of any other
type by their text; rows that repeat give equal rows; blanks only are one unit; a document of any length is cut whole
(memory for one document grows with it); an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SEED = 42
#: Shares, in hundredths: of documents that are transformed, and of these in the order ``spm``.
RATE, SPM_RATE = 50, 80
SENTINELS = ("<P>", "<S>", "<M>")
CHUNK_BYTES = 4 << 20
_BLANK = r"[\x20\x09-\x0D]"
UNIT = rf"{_BLANK}*[^\x20\x09-\x0D]+|{_BLANK}+"


def _sql(seed: int, rate: int, spm_rate: int) -> str:
    p, s, m = SENTINELS
    number = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::bigint"
    return f"""
    with cut as (select k, text, regexp_extract_all(text, '{UNIT}') as units, sha256('{seed}:' || id) as h from batch),
    placed as (select *, len(units) as n, {number(0)} % (len(units) + 1) as x, {number(1)} % (len(units) + 1) as y,
        case when text = '' or contains(text, '{p}') or contains(text, '{s}') or contains(text, '{m}') or {number(2)} % 100 >= {rate} then 'plain'
             when {number(3)} % 100 < {spm_rate} then 'spm' else 'psm' end as form from cut),
    parts as (select k, n, form, text,
        case when form <> 'plain' then array_to_string(list_slice(units, 1, least(x, y)), '') end as prefix,
        case when form <> 'plain' then array_to_string(list_slice(units, least(x, y) + 1, greatest(x, y)), '') end as middle,
        case when form <> 'plain' then array_to_string(list_slice(units, greatest(x, y) + 1, n), '') end as suffix from placed)
    select k::bigint as k, n::bigint as n, form, length(prefix)::bigint as prefix_chars, length(middle)::bigint as middle_chars,
        case form when 'plain' then text when 'psm' then '{p}' || prefix || '{s}' || suffix || '{m}' || middle else '{s}' || suffix || '{p}' || prefix || '{m}' || middle end as output
    from parts order by k"""


def _transformed(batches: Iterator[pa.RecordBatch], sql: str) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1})
    try:
        for rows in batches:
            for part in slices(rows, 1, CHUNK_BYTES):
                k = pa.array(np.arange(part.num_rows))
                con.register("batch", pa.table({"k": k, "id": part.column(2), "text": part.column(1).fill_null("")}))
                out = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("batch")
                made = pa.table({"id": part.column(0).take(out.column("k").combine_chunks())} | {c: out.column(c) for c in out.column_names if c != "k"})
                made = made.set_column(made.schema.get_field_index("output"), "output", made.column("output").cast(pa.large_string()))
                yield from made.to_batches()
    finally:
        con.close()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per row: id, n, form, prefix_chars, middle_chars (code points; null if plain), output."""
    key = F.col(f"`{id_col}`")
    rows = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(key.cast("string"), F.lit("")).alias("said"))
    sql = _sql(seed, rate, spm_rate)
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _transformed(it, sql), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from the output and its form alone."""
    p, s, m = SENTINELS
    after = lambda text, mark: F.substr(text, F.length(F.substring_index(text, mark, 1)) + len(mark) + 1)
    before = lambda text, mark: F.substring_index(text, mark, 1)
    middle = after(output, m)
    psm = F.concat(before(after(output, p), s), middle, before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), middle, before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: Parts by code points of the text, where the operator joins units; the restored text is the text.
SQL = rf"""
with numbered as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || doc_id::varchar) as h from documents
), counted as (
    select *, list_transform(regexp_extract_all(text, '{UNIT}'), lambda u: length(u)) as sizes from numbered
), numbers as (
    select *, len(sizes) as n, list_transform([1, 9, 17, 25], lambda i: list_reduce(list_transform(string_split(substr(h, i, 8), ''), lambda c: (instr('0123456789abcdef', c) - 1)::bigint), lambda v, c: 16 * v + c)) as v from counted
), cuts as (
    select *, least(v[1] % (n + 1), v[2] % (n + 1)) as a, greatest(v[1] % (n + 1), v[2] % (n + 1)) as b,
        case when text = '' or regexp_matches(text, '<[PSM]>') or v[3] % 100 >= 50 then 'plain' when v[4] % 100 < 80 then 'spm' else 'psm' end as form from numbers
), chars as (
    select *, coalesce(list_sum(sizes[1:a]), 0)::bigint as pre, coalesce(list_sum(sizes[a + 1:b]), 0)::bigint as mid from cuts
), parts as (
    select *, substr(text, 1, pre) as prefix, substr(text, pre + 1, mid) as middle, substr(text, pre + mid + 1) as suffix from chars
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then pre end as prefix_chars, case when form <> 'plain' then mid end as middle_chars,
    sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
    sha256(text) as restored_sha256
from parts
"""
