import random
import struct

import pyspark.sql.functions as F
import pytest

from loquat.operators import g2p as G
from loquat.operators.g2p import phonemize, tokens
from loquat.plans import cases
from loquat.sources import lexicon as L
from loquat.sources import pooled as P


def test_tokens(spark):
    df = spark.createDataFrame([("It's a-b, <en>C’d e.</en>\nđẹp!",)], "t string")
    got = [(t.word, t.tagged) for t in df.select(tokens(F.col("t")).alias("t")).first().t]
    assert got == [("It's", False), ("a", False), ("-", False), ("b", False), (",", False), ("C’d", True), ("e", True), (".", True), ("đẹp", False), ("!", False)]


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "túi to."), (3, "túi to."), (None, "market")], "id int, text string")
    small = spark.createDataFrame(cases.SMALL_LEXICON, L.SCHEMA)
    got = sorted(map(str, ((r.id, r.phonemes) for r in phonemize(df, small).collect())))
    assert got == sorted(map(str, [(1, ""), (2, ""), (3, "vi-túi vi-to."), (3, "vi-túi vi-to."), (None, "en-market")]))
    assert phonemize(df.filter("false"), small).count() == 0
    assert {r.phonemes for r in phonemize(df, small.filter("false")).collect()} == {"", "túi to.", "market"}


def test_overlay_prefers_the_first_lexicon(spark):
    a = spark.createDataFrame([L.merged("x", "one")], L.SCHEMA)
    b = spark.createDataFrame([L.merged("x", "two"), L.common("y", "v", "e")], L.SCHEMA)
    assert {(r.word, r.phone) for r in L.overlay(a, b).collect()} == {("x", "one"), ("y", None)}


def test_pooled_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "words.bin")
    rows = [*cases.SMALL_LEXICON, L.merged("đẹp", "ɗˈɛ6p"), L.common("x", "", "eks")]
    L.save_lexicon(spark.createDataFrame(rows, L.SCHEMA), path)
    assert sorted(map(str, map(tuple, L.load_lexicon(spark, path).collect()))) == sorted(map(str, rows))
    spark.createDataFrame(rows, L.SCHEMA).write.parquet(f"{path}.parquet")
    assert L.load_lexicon(spark, f"{path}.parquet").count() == len(rows)
    with pytest.raises(FileNotFoundError):
        L.load_lexicon(spark, path + "x")
    (tmp_path / "bad.bin").write_bytes(b"nothing of the kind" * 4)
    with pytest.raises(ValueError):
        L.load_lexicon(spark, str(tmp_path / "bad.bin"))


def test_a_joined_lexicon_gives_the_same(spark, monkeypatch):
    """Shared words in any order between words of one language, commas and stops; unknown, tagged and odd words."""
    rng = random.Random(5)
    words = ["túi", "to", "market", "on", "a", "unknown", "marketto", "đẹp", "b", "x9", "<en>to market</en>", "<en>on</en>", ",", ".", "-", "!", "Ⓐ", "é", "漢字", "\x01"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", " ", "túi", "túi"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").union(spark.createDataFrame([(7, texts[7])], "id int, text string"))
    small = spark.createDataFrame(cases.SMALL_LEXICON, L.SCHEMA)
    for lexicon in (small, L.seed_lexicon(spark)):
        held = sorted(map(tuple, phonemize(df, lexicon).collect()))
        monkeypatch.setattr(G, "HELD_WORDS", 0)
        assert sorted(map(tuple, phonemize(df, lexicon).collect())) == held
        monkeypatch.setattr(G, "TOKENS_AT_ONCE", 3)
        assert sorted(map(tuple, phonemize(df, lexicon).collect())) == held
        monkeypatch.undo()
    assert len(held) == len(texts) + 1


def test_nothing_is_shuffled(spark):
    df = spark.range(10).selectExpr("id", "concat('túi ', id) as text")
    plan = phonemize(df, spark.createDataFrame(cases.SMALL_LEXICON, L.SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_pooled_file_with_strings_out_of_range_or_not_utf8(spark, tmp_path):
    path = tmp_path / "odd.bin"
    pool = b"abc\0\xff\xfe\0"
    at = P.BASE + len(pool)
    records = [(0, 9), (1, 0), (0, 0)]  # a phoneme out of range, a word that isn't UTF-8, a sound one
    path.write_bytes(P.HEADER.pack(P.MAGIC, 2, 3, 0, at, at + 8, at + 8 + 24) + pool + struct.pack("<2I", 0, 4) + b"".join(struct.pack("<2I", *r) for r in records))
    got = [(r.word, r.phone) for r in L.load_lexicon(spark, str(path)).collect()]
    assert sorted(got) == [("", "abc"), ("abc", ""), ("abc", "abc")]
    path.write_bytes(b"SEA")
    with pytest.raises(ValueError):
        L.load_lexicon(spark, str(path))


def test_of_a_large_lexicon_workers_hold_what_texts_meet(spark, monkeypatch):
    """Words, pieces of unknown and of shared words, single letters: the same as with all of it, and nothing is exchanged."""
    texts = ["túi to on", "marketto to", "<en>to túi</en> abz", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    many = spark.createDataFrame([*cases.SMALL_LEXICON, L.merged("z", "zed", True), *(L.merged(f"word{k}", "w") for k in range(500))], L.SCHEMA)
    want = sorted(map(tuple, phonemize(df, many).collect()))
    monkeypatch.setattr(G, "HELD_WORDS", 50)
    got = phonemize(df, many)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want and "Exchange" not in plan and "Join" not in plan
