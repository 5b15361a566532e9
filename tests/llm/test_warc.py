import hashlib

import pytest

from loquat.llm import warc as R
from loquat.llm.common import Stage

EMBEDDED = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
LONG = "é<p>\r\n\r\ntext</p>" * 3000


def rows():
    out = [(1, "http://a", LONG), (2, "http://b", LONG), (3, "u\r\nContent-Length: 1", "short"), (4, None, "short"), (5, "", None), (6, "x", "")]
    out += [(7, "m", "before " + EMBEDDED * 3 + "after"), (8, "m", "WARC/1.0\r\n"), (9, "m", "WARC/1.0\r\nContent-Length: 99999\r\n\r\n" + "q" * 120)]
    out += [(10, "m", "before " + EMBEDDED * 3 + "after"), (11, "n", "x" * 99), (12, "n", "x" * 99), (13, "n", "y" * 100), (14, "n", "y" * 100)]
    out += [(15, "e", "WARC/1.0\r\n" * 2000 + EMBEDDED)]
    return out + [(k, "z", f"page {k} " * (k % 50)) for k in range(20, 120)]


def expected(table):
    first = {}
    for i, _, html in sorted(r for r in table):
        first.setdefault(html or "", i)
    out = []
    for i, _, html in table:
        data = (html or "").encode()
        again = len(data) >= 100 and first[html or ""] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out)


@pytest.mark.parametrize("split", ["128m", "3k"])
def test_round_trip(spark, tmp_path, split):
    table = rows()
    df = spark.createDataFrame([(*r, "t", 1) for r in table], "page_id long, url string, html string, type string, bytes int").repartition(3)
    stage = Stage(spark, "warc-test")
    R.write_archive(df, stage.path("archive"), stage, "page_id", "url", "html")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = R.read_archive(spark, stage.path("archive"), stage).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = sorted((r.id, r.stated_bytes if r.type == "revisit" else r.bytes, r.stated_digest if r.type == "revisit" else r.digest, r.type, r.refers_to) for r in got)
    assert found == expected(table)
    assert all(r.stated_digest == r.digest for r in got if r.type == "response")


def test_null_ids_repeats_and_empty(spark):
    page = "p" * 150
    df = spark.createDataFrame([(None, "a", page), (3, "a", page), (3, "a", page), (9, "a", page)], "page_id long, url string, html string")
    stage = Stage(spark, "warc-test")
    R.write_archive(df, stage.path("a"), stage, "page_id", "url", "html")
    got = sorted((str(r.id), r.type, r.refers_to) for r in R.read_archive(spark, stage.path("a"), stage).collect())
    assert got == [("3", "response", None), ("3", "response", None), ("9", "revisit", 3), ("None", "revisit", 3)]
    R.write_archive(df.filter("false"), stage.path("b"), Stage(spark, "warc-test"), "page_id", "url", "html")
    assert R.read_archive(spark, stage.path("b"), Stage(spark, "warc-test")).count() == 0
