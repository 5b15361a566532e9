import pyspark.sql.functions as F
import pytest

from loquat.functions import numbers as N


def plain(n):
    """A second spelling of the rules, on integers."""
    if n == 0:
        return "không"
    words, scale = [], 0
    while n:
        n, group = divmod(n, 1000)
        if group:
            h, t, u = group // 100, group // 10 % 10, group % 10
            part = []
            if h or n:
                part.append(N.DIGITS[h] + " trăm")
            if t > 1:
                part.append(N.DIGITS[t] + " mươi")
            elif t == 1:
                part.append("mười")
            elif u and part:
                part.append("lẻ")
            if u:
                part.append("mốt" if u == 1 and t > 1 else "lăm" if u == 5 and t else N.DIGITS[u])
            words.insert(0, " ".join(part) + ["", " nghìn", " triệu"][scale % 3] + " tỷ" * (scale // 3))
        scale += 1
    return " ".join(words)


def test_whole_numbers(spark):
    wanted = [*range(0, 1200), *range(9_990, 10_120), 10**6, 10**6 + 5, 10**9, 10**12, 10**18, 10**20 + 15, 123_456_789_012_345_678_901]
    df = spark.createDataFrame([(str(n),) for n in wanted if n > 9 or n == 0], "n string")
    for r in df.select("n", N.n2w(F.col("n")).alias("w")).collect():
        assert r.w == plain(int(r.n)), r.n


@pytest.mark.parametrize("text,want", [("00", "không không"), ("05", "không năm"), ("007", "bảy"), ("000", "không"), ("", ""), ("1a", "1a"), ("1-2.3", "một trăm hai mươi ba"), (None, None)])
def test_other_texts(spark, text, want):
    df = spark.createDataFrame([(text,)], "n string")
    assert df.select(N.n2w(F.col("n")).alias("w")).first().w == want
