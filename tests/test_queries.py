"""Queries whose SQL gives exact values are run beside it on the smallest tables."""

import os
import time

import duckdb
import pytest

import __spark_entry__ as entry
from loquat.plans import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = list(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    if os.path.isdir(FOLDER):
        for file in os.listdir(FOLDER):
            con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    got = registry.queries()[name](spark, FOLDER)
    names = sorted(got.columns)
    want = duck.execute(f"select {', '.join(names)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_addresses_behind_long_runs(spark, duck, tmp_path):
    """Found as by SQL behind any number of signs, and about as fast in plain text as without a look behind."""
    texts = [f"{'.' * 100}a@b.vn", f"{'%' * 61}a.b@c.vn x", "a.b@c.vn,..d@e.vn", "a@b.c|9x@y.com", "no address", "", None, *["the quick brown fox jumps " * 8_000] * 12]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = registry.queries()["email_docs"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert time.time() - began < 10  # some 90 seconds of a core before
    want = duck.execute(registry.oracle_sql()["email_docs"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert list(map(tuple, got)) == sorted(want)
    assert got[0].emails == "a@b.vn"
