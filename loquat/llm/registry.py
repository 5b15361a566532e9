"""Queries of the training-data operators over the driver's tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, decontaminate, fill_in_middle, jaccard_join, licenses, line_dedup, packing, quality, secrets, substring_dedup, url_filter, warc

_QUERIES = {
    "op1_ann": ann.query,
    "op2_packing": packing.query,
    "op3_line_dedup": line_dedup.query,
    "op4_quality": quality.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_licenses": licenses.query,
    "op7_url_filter": url_filter.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_warc": warc.query,
    "op10_decontaminate": decontaminate.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_secrets": secrets.query,
    "op13_alignment": alignment.query,
}

_SQL = {
    "op3_line_dedup": line_dedup.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op6_licenses": licenses.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op9_warc": warc.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op12_secrets": secrets.SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
