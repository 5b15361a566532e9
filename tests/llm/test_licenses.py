import os

import duckdb
import pytest

from loquat.llm import licenses as L


def rows():
    return [
        (1, L._MIT), (2, "Copyright (c) 2020 Someone\n\n" + L._MIT.upper().replace(",", " ;")), (3, L._MIT + " and more"), (4, None), (5, ""), (6, "?!\n."),
        (7, L._ISC.replace("license", "licence")), (8, "text\n  licensed under CC BY-NC 4.0!\nReleased under the MIT Licence\nmore"), (9, "SPDX-License-Identifier: MIT"), (10, "word " * 40000), (11, "Copyright 1999 X"),
        (12, "Copyright (c) Jane Doe\n" + L._MIT), (13, "the licence licence whilst whilst x per cent per cent y"), (14, "© Jane Doe\n" + L._MIT), (15, L._BSD.format(third=L._THIRD, holder="HOLDER").replace("\n\n", "\n").lower()),
        (16, "a\n  copyright notice, this list\n(c) You must\nCOPYRIGHT © me\n* (c) 2020 you\nend"), (17, "Licenced under the MIT licence"),
    ]


def test_scan(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows()], "doc_id long, text string, license string, digest int")
    got = {r.doc_id: (r.license, r.notices) for r in L.scan(df, L.known_digests(spark)).collect()}
    assert got[1][0] == got[2][0] == "MIT" and got[3] == (None, "") and got[7][0] == "ISC"
    assert got[4] == got[5] == got[6] == got[10] == got[11] == (None, "")
    assert got[12][0] == "MIT" and got[14][0] is None and got[15][0] == "BSD-3-Clause" and got[17] == ("MIT", "MIT")
    assert got[8] == (None, "CC-BY-NC-4.0,MIT") and got[9] == ("MIT", "MIT")


def test_sql_agrees(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows())
    got = L.scan(df, L.known_digests(spark)).select("doc_id", "digest", "license", "notices").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(L.SQL).fetchall())


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, L._MIT), (1, L._MIT), (1, L._MIT)], "doc_id long, text string")
    assert [r.license for r in L.scan(df, L.known_digests(spark)).collect()] == ["MIT"] * 3
    assert L.scan(df.filter("false"), L.known_digests(spark)).count() == 0
    assert L.scan(df, L.known_digests(spark, [])).filter("license is not null").count() == 0


def test_equal_spellings_beside_each_other_and_copyright_lines(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", L.canonical(df.text).alias("c")).collect()}
    assert got[13] == "the license license while while x percent percent y"
    assert got[16] == "a copyright notice this list c you must end"


def test_published_texts_by_digest(spark):
    known = {r.license for r in L.known_digests(spark).collect()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-3-Clause", "Unlicense"} <= known
    path = "/usr/share/common-licenses/MPL-2.0"
    if not os.path.exists(path):
        pytest.skip("no licence texts here")
    df = spark.createDataFrame([("a", open(path, encoding="utf-8").read().upper(), 1)], "doc_id string, text string, key int")
    assert [tuple(r)[0::2] for r in L.scan(df, L.known_digests(spark)).collect()] == [("a", "MPL-2.0")]
