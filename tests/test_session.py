"""SQL functions give what the Column expressions give."""

import pytest
from pyspark.sql import functions as F

from loquat import register_functions
from loquat.operators.g2p import tokens
from loquat.plans import cases
from loquat.session import SCALARS, as_sql

QUOTES = ["it's \\ 'so'", "=(", "a = 'b'", "<=(and(", ""]


def test_printed_columns_are_read_back(spark):
    rows = spark.createDataFrame([(q,) for q in QUOTES], "text string")
    for literal in QUOTES:
        column = F.when((F.col("text") == literal) & ~F.col("text").contains("zz"), F.concat(F.lit(literal), -F.length("text") + 1)).otherwise(F.lit("=("))
        both = rows.select(column.alias("a"), F.expr(as_sql(column)).alias("b"))
        assert all(r.a == r.b for r in both.collect())


def test_rules_with_cases(spark):
    named = {rule.__name__: (rule, [t for t, _ in inputs]) for rule, inputs in cases.RULES.values() if getattr(rule, "__name__", None) in SCALARS}
    some = ["full_date", "number_range", "measured", "technical", "acronyms", "roman"]
    assert set(some) <= set(named)
    assert register_functions(spark, some) == [f"loquat_{n}" for n in some]
    for name in some:
        rule, texts = named[name]
        rows = spark.createDataFrame([(t,) for t in [*texts, *QUOTES, None]], "text string")
        for r in rows.select("text", rule(F.col("text")).alias("a"), F.expr(f"loquat_{name}(text)").alias("b")).collect():
            assert r.a == r.b, (name, r.text)


def test_token_rows(spark):
    register_functions(spark, ["tokens"])
    rows = spark.createDataFrame([(1, "xin chào <en>hello you</en>, 2 it's"), (2, ""), (3, None), (4, "a\nb")], "id int, text string")
    got = spark.sql("SELECT id, t.position, t.word, t.tagged FROM {rows}, LATERAL loquat_tokens(text) t", rows=rows)
    want = rows.select("id", F.posexplode(tokens(F.col("text"))).alias("position", "t")).select("id", "position", "t.word", "t.tagged")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_unknown_name(spark):
    with pytest.raises(ValueError, match="no function"):
        register_functions(spark, ["nothing"])
