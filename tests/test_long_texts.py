"""No text ends a job: every rule, the whole chain and the tokens over long runs of each part that repeats somewhere."""

import time

import pytest
from pyspark.sql import functions as F

from loquat import normalize
from loquat.operators import normalize as R
from loquat.operators.g2p import tokens

REPEATS = 100_000
#: Parts, each repeated; what repeated groups, their separators and failing searches are made of.
PARTS = ["1.", "1,", "1,1.", "a.", "a-", "a_", "a_b.", "1 ", "1", "0912345678 ", ".", ",", ", ", "!", "! ", "(", "( ", "(\n", "[a] ", "<en>", "<en>a</en>", "'", "' ", "-", " - ", "/", "/.", "//a", "a@", "@", "a.b@", "A", "A1", "AB. ", "1/", "1:", "é", "é.",
         "m^2 ", "5km ", "5km/h ", "$1 ", "5% ", "-5 ", "v.v", "http://", "www.", ".com", "TP.HCM ", "IV ", "a's ", " ", "\n", "\t", "ngày ", "1-2 ", "10^3 ", "\u2c30", ": ", "°", "->", "  ->", "̣", "ậ", "각", "1e5 ", "từ 1 - ", "lúc ", "chữ ", "\xa0", "C:\\", "x*", "1x", "word ", "漢"]
TAILS = ["", "é", "%", "@b.vn", ")", "x km/h"]
RULES = {f.__name__: f for f in R.RULES} | {"compose": R.compose, "ascii_digits": R.ascii_digits, "single_letters": R.single_letters, "inner_dots": R.inner_dots, "tidy": R.tidy, "plain_tags": R.plain_tags, "technical": R.technical, "email": R.email}
#: Rules that run over all texts here; the others over those of their own parts.
HEAVY = ["compound_units", "many_commas", "versions", "percent", "prefix_currency", "suffix_currency", "measured", "brackets_and_degrees", "tidy", "acronyms", "compose", "quotes_and_symbols"]


def made(spark, repeats, tails=TAILS):
    rows = [(p, t) for p in PARTS for t in tails[: 1 + len(tails) * (len(p) < 4)]]
    return spark.createDataFrame(rows, "part string, tail string").repartition(32).withColumn("text", F.concat(F.repeat("part", repeats), F.col("tail")))


@pytest.mark.parametrize("name", HEAVY)
def test_rules_over_many_parts(spark, name):
    texts, began = made(spark, REPEATS, ["", "é"]), time.time()
    got = texts.select(F.length(RULES[name](F.col("text"))).alias("n")).collect()
    assert len(got) == texts.count() and all(r.n is not None for r in got)
    assert time.time() - began < 120  # some 140 texts of up to a megabyte


def test_every_rule(spark):
    """All rules at once over fewer parts: a search with the square of the text, or the stack, would still show."""
    texts, began = made(spark, 4_000, [""]), time.time()
    for name, rule in RULES.items():
        assert all(r.n is not None for r in texts.select(F.length(rule(F.col("text"))).alias("n")).collect()), name
    assert time.time() - began < 200


def test_the_chain_and_tokens(spark):
    texts, began = made(spark, 2_000, [""]), time.time()
    out = normalize(texts, "text").select("part", F.length("normalized").alias("n"), F.size(tokens(F.col("text"))).alias("tokens")).collect()
    assert len(out) == len(PARTS) and all(r.n is not None and r.tokens is not None for r in out)
    blanks = spark.createDataFrame([(" ",), ("\n",), ("x ",), ("1.",), ("it's",)], "part string").withColumn("text", F.repeat("part", F.when(F.col("part").rlike("[a-z0-9]"), 50_000).otherwise(1_000_000)))
    out = normalize(blanks, "text").select("part", F.length("normalized").alias("n"), F.size(tokens(F.col("text"))).alias("tokens")).collect()
    assert {r.part: r.n for r in out}[" "] == 0 and len(out) == 5
    assert time.time() - began < 240


def test_addresses_in_linear_time(spark):
    rows = spark.createDataFrame([("a." * 200_000 + "@", 0), ("a." * 200_000 + "b@c.vn", 1), ("1.1." * 100_000 + "com", 1), ("a@" + "b." * 200_000 + "1", 0)], "text string, n int")
    began = time.time()
    from loquat.functions import patterns as P

    got = rows.select("n", F.size(F.regexp_extract_all("text", F.lit(P.EMAIL), F.lit(0))).alias("mail"), F.size(F.regexp_extract_all("text", F.lit(P.TECHNICAL), F.lit(0))).alias("name")).collect()
    assert [r.mail for r in got] == [0, 1, 0, 0] and all(r.name for r in got)
    assert time.time() - began < 30


def test_letters_are_passed_before_the_long_list(spark):
    """Unknown characters in plain text: against the same search without the test that comes first."""
    from loquat.functions import patterns as P

    text = spark.range(4).repartition(4).select(F.repeat(F.lit("the quick brown fox jumps over "), 60_000).alias("text")).cache()
    assert text.count() == 4

    def seconds(pattern):
        began = time.time()
        assert not any(r.n for r in text.select(F.col("text").rlike(pattern).alias("n")).collect())
        return time.time() - began

    plain = P.UNKNOWN.replace("(?![a-zA-Z ])", "")
    times = [(seconds(P.UNKNOWN), seconds(plain)) for _ in range(3)]
    assert min(a for a, _ in times) < 0.8 * min(b for _, b in times), times


def test_plain_words_are_passed_before_names(spark):
    """Names in plain text: against the same search without the tests that come first."""
    from loquat.functions import patterns as P

    text = spark.range(4).repartition(4).select(F.repeat(F.lit("the quick brown fox jumps over "), 20_000).alias("text")).cache()
    assert text.count() == 4
    first = P.TECHNICAL.index(r"\b(?-i:(?=[a-zA-Z0-9"), P.TECHNICAL.index(r"(?:\b(?:https?")
    plain = P.TECHNICAL[: first[0]] + P.TECHNICAL[first[1] :]

    def seconds(pattern):
        began = time.time()
        assert not any(r.n for r in text.select(F.col("text").rlike(pattern).alias("n")).collect())
        return time.time() - began

    times = [(seconds(P.TECHNICAL), seconds(plain)) for _ in range(3)]
    assert min(a for a, _ in times) < 0.8 * min(b for _, b in times), times
