import random

import duckdb
import pyspark.sql.functions as F

from loquat.llm import line_dedup as L


def corpus():
    rng = random.Random(6)
    say = lambda k: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(k))
    docs = []
    for i in range(60):
        lines = [say(rng.randint(1, 12)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), f"User {i} logged in from host {i * 7} today again")
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), "Please read our terms of " + rng.choice(["use", "service"]) + " before you go")
        docs.append((i, "\n".join(lines)))
    copied = "\n".join(say(9) for _ in range(5))
    docs += [(100 + k, copied) for k in range(12)]  # equal copies
    docs += [(200 + k, copied + f"\nending {say(6)}") for k in range(12)]  # near copies
    docs += [(300, None), (301, ""), (302, "\n\n"), (303, "User 1 logged in from host 2 today again"), (304, "one two three four five " * 4000)]
    return docs


def test_templates_go_and_copies_stay(spark):
    docs = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_lines int, leaf string")
    out = {r.doc_id: r for r in L.drop_templates(df).collect()}
    assert len(out) == len(docs) and out[300].text is None and out[300].n_lines == 0 and out[301].n_lines == 1 and out[303].text == ""
    for i, text in docs:
        if text is None:
            continue
        want = [x for x in text.split("\n") if not x.startswith("User ") and not x.startswith("Please read")]
        assert out[i].text == "\n".join(want) and out[i].n_dropped == len(text.split("\n")) - len(want) and out[i].leaf == "x"


def test_sql_agrees(spark):
    docs = [r for r in corpus()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = L.drop_templates(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256))
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    assert sorted(map(tuple, kept.collect())) == sorted(con.execute(L.SQL).fetchall())


def test_repeated_rows_null_ids_and_empty(spark):
    line = "All users must accept these terms now"
    rows = [(None, f"a\n{line}"), (1, f"b\n{line}"), (1, f"b\n{line}"), (1, f"c\n{line}"), (2, f"d\n{line}"), (3, f"e e\n{line}\nf f"), (4, f"x x x x x x\n{line}\ny y y y y y"), (5, f"{line}\nz z z z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = L.drop_templates(df).collect()
    assert len(out) == len(rows) and all(line not in r.text for r in out) and all(r.n_dropped == 1 for r in out)
    assert L.drop_templates(df.filter("false")).count() == 0


def test_runs_of_lines_and_hot_copies(spark):
    rng = random.Random(7)
    say = lambda k: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(k))
    own = lambda: "\n".join(say(rng.randint(6, 14)) for _ in range(8))
    footer = "This site keeps cookies for its visitors\n\nPlease write to the editors of the paper\nNo part of it may be copied"
    line = "Sign up for the letter of the week"
    body = [say(9) for _ in range(10)]
    docs = [(i, own() + "\n" + footer) for i in range(12)]
    docs += [(100 + i, own() + "\n" + line + "\n" + own()) for i in range(12)]
    docs += [(200 + i, "\n".join([*body[:5], line, *body[5:], say(8)])) for i in range(60)]  # near copies that hold the line
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in L.drop_templates(df).collect()}
    for i, text in docs:
        want = [x for x in text.split("\n") if x != line and (not x or x not in footer)]
        assert out[i].text == "\n".join(want), i


def test_short_lines_need_more_documents(spark):
    rng = random.Random(8)
    say = lambda k: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(k))
    own = lambda: "\n".join(say(rng.randint(6, 14)) for _ in range(6))
    short = {"All rights reserved.": 15, "Terms of our use": 10, "Page 7": 20, "Menu": 25, "Too few here": 14, "Once": 24, "日本語の一行です。": 30}
    docs = []
    for line, n in short.items():
        docs += [(len(docs) + k, own() + f"\n{line}\n" + own()) for k in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.text for r in L.drop_templates(df).collect()}
    for i, text in docs:
        want = [x for x in text.split("\n") if x not in short or x in ("Too few here", "Once")]
        assert out[i] == "\n".join(want), i
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    kept = L.drop_templates(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256))
    assert sorted(map(tuple, kept.collect())) == sorted(con.execute(L.SQL).fetchall())


def test_columns_with_the_names_of_the_operator(spark):
    names = ["_row", "_text", "_kept", "_gone", "_gone_digest", "_digest", "n_lines", "n_dropped", "leaf", "form", "template", "a.b"]
    docs = corpus()
    df = spark.createDataFrame([(f"x{i}", t, *range(len(names))) for i, t in docs], "doc_id string, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = L.drop_templates(df)
    assert sorted(out.columns) == sorted(df.columns)
    plain = {f"x{r.doc_id}": (r.text, r.n_dropped) for r in L.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {r.doc_id: (r.text, r.n_dropped) for r in out.collect()} == plain and out.first()["a.b"] == 11
