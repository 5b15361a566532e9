"""Lexicon files: what is written comes back, by scan, filter and search, and searches read little."""

import os

import pyspark.sql.functions as F
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from loquat.sources import lexicon as L
from loquat.sources import pooled as P

N = 120_000


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """Words ``w0`` to ``w119999`` (every third is common), some of other scripts, in many tasks."""
    path = f"file://{tmp_path_factory.mktemp('lexicon')}/big.bin"
    common = F.col("id") % 3 == 0
    said = lambda mark: F.concat(F.lit(mark), F.col("id").cast("string"))
    rows = spark.range(0, N, 1, 9).select(said("w").alias("word"), F.when(common, "common").otherwise("merged").alias("kind"), F.when(~common, F.concat(F.lit("p"), F.col("id") % 50)).alias("phone"), F.when(~common, F.col("id") % 2 == 0).alias("is_en"), F.when(common, said("v")).alias("vi_phone"), F.when(common, said("e")).alias("en_phone"))
    rows = rows.unionByName(spark.createDataFrame([L.merged("đẹp", "a"), L.merged("漢", "b", True), L.common("𝒳y", "", "c")], L.SCHEMA)).persist()
    L.save_lexicon(rows, path)
    return path, rows


def read(path, *filters):
    """Rows and bytes read by a reader with ``filters`` pushed, in this process."""
    reader = P.SearchingReader(path)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    opened, make = [], P.PooledFile
    try:
        P.PooledFile = lambda *a: opened.append(make(*a)) or opened[-1]
        rows = [row for part in reader.partitions() for row in reader.read(part)]
    finally:
        P.PooledFile = make
    return rows, sum(f.bytes_read for f in opened)


def test_everything_comes_back(spark, big):
    path, rows = big
    back = L.load_lexicon(spark, path)
    assert back.count() == N + 3 and back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    assert back.rdd.getNumPartitions() >= 3
    assert [f for f in os.listdir(os.path.dirname(path.removeprefix("file://"))) if not f.startswith(".")] == ["big.bin"]


@pytest.mark.parametrize(
    "test",
    ["word = 'w777'", "word IN ('w1', 'w119999', 'none', 'đẹp', '漢')", "word > 'w5' AND word <= 'w500'", "word >= '漢'", "word < 'w10'", "word LIKE 'w99%'", "word LIKE '𝒳%'", "kind = 'common' AND word LIKE 'w11%'",
     "word = 'w1' AND word = 'w2'", "word = ''", "word IS NULL", "word <=> 'w9' OR kind = 'none'", "kind = 'none'"],
)
def test_filters_give_what_a_scan_gives(spark, big, test):
    path, rows = big
    assert sorted(map(repr, L.load_lexicon(spark, path).filter(test).collect())) == sorted(map(repr, rows.filter(test).collect()))


def test_searches_read_in_proportion(big):
    path, _ = big
    size = os.path.getsize(path.removeprefix("file://"))
    rows, used = read(path, EqualTo(("word",), "w777"))
    assert rows == [("w777", "common", None, None, "v777", "e777")] and used < size / 8
    rows, used = read(path, In(("word",), ("w1", "w2", "nowhere", None)))
    assert [r[0] for r in rows] == ["w1", "w2"] and used < size / 6
    rows, used = read(path, StringStartsWith(("word",), "w999"))
    assert len(rows) == 111 and used < size / 5
    few, used = read(path, GreaterThan(("word",), "w9999"), LessThanOrEqual(("word",), "w99999"))
    assert len(few) == 10 and used < size / 5
    rows, used = read(path)
    assert len(rows) == N + 3 and used >= size


def test_search_by_a_table_of_words(spark, big):
    path, rows = big
    words = spark.createDataFrame([("w5",), ("w5",), (None,), ("none",), ("đẹp",), ("",)], "w string").withColumn("extra", F.lit(1))
    got = P.search_lexicon(words, path, "w")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.filter("word IN ('w5', 'đẹp')").collect()))
    assert P.search_lexicon(words.filter("false"), path, "w").isEmpty()
    every = P.search_lexicon(rows.select("word"), path)
    assert every.count() == N + 3 and every.exceptAll(rows).isEmpty()


def test_what_cannot_be_written(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    save = lambda rows, **how: L.save_lexicon(spark.createDataFrame(rows, L.SCHEMA), path, **how)
    for bad in ([L.merged("a\0b", "c")], [L.merged(None, "c")], [("a", "other", "b", False, None, None)]):
        with pytest.raises(Exception, match="zero byte|no word"):
            save(bad)
        assert os.listdir(tmp_path) == []
    save([])
    assert L.load_lexicon(spark, path).isEmpty() and L.load_lexicon(spark, path).filter("word = 'a'").isEmpty()
    with pytest.raises(Exception, match="x.bin"):
        save([L.merged("a", "b")])
    save([L.merged("a", "b"), L.merged("a", "c"), ("n", "merged", None, None, "no", "no")], overwrite=True)
    assert sorted(map(tuple, L.load_lexicon(spark, path).collect())) == [L.merged("a", "b"), L.merged("n", "")]


def test_rows_must_come_sorted_in_ranges(spark, tmp_path):
    spark.dataSource.register(P.PooledLexicon)
    save = lambda df: df.write.format("pooled_lexicon").mode("append").save(str(tmp_path / "y.bin"))
    rows = [L.merged(w, w) for w in ("b", "a")]
    with pytest.raises(Exception, match="sorted"):
        save(spark.createDataFrame(rows, L.SCHEMA).coalesce(1))
    crossing = spark.range(0, 4, 1, 2).selectExpr("substr('acbd', id + 1, 1) as word", "'merged' as kind", "'p' as phone", "false as is_en", "null as vi_phone", "null as en_phone")
    with pytest.raises(Exception, match="ranges"):
        save(crossing)
    assert not (tmp_path / "y.bin").exists()
