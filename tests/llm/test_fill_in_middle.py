import hashlib
import random
import re

import duckdb
import pytest

from loquat.llm import fill_in_middle as M

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text):
    """The transformation, one row at a time."""
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    x, y = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return n, "plain", None, None, text
    pre, mid, suf = ("".join(u) for u in (units[:x], units[x:y], units[y:]))
    if d % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def made():
    rng = random.Random(11)
    parts = ["a", "bc", " ", "\n", "\t", "\x0b", "\x0c", "\r", "é", "漢字", "𝔘", "\xa0", " ", "<", "P>", "<P", "S>", "'", "\\", "\x00", "|", "\x1f", "\x85", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    return texts + [None, "", " ", "\n" * 7, "x", "a <P> b", "<S>", "q<M>", "word " * 200_000, " " * 1_000_000, "z" * 1_000_000, *["same text twice"] * 40]


def test_against_brute_force(spark):
    rows = [(k if k % 50 else None, t, 5, "x") for k, t in enumerate(made())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, `a.b c` string").repartition(3)
    out = M.fill_in_middle(df)
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.withColumn("back", M.restored(out.output, out.form)).collect())
    want = sorted((str(i), *plain(i, t), t or "") for i, t, *_ in rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    key = lambda r: (r[0], r[5])
    assert sorted(map(repr, got)) == sorted(map(repr, want)) or next((g, w) for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True) if g != w) is None
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_chunks_of_one_batch(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(M, "CHUNK_BYTES", 50)
    rows = [(k, "some words here " * (k % 5)) for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows]), pa.array([str(i) for i, _ in rows])], names=["id", "text", "said"])
    out = [r for b in M._transformed(iter([batch]), M._sql(42, 50, 80)) for r in b.to_pylist()]
    assert [(r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out] == [(i, *plain(i, t)) for i, t in rows]


def test_rates_ids_and_empty(spark):
    texts = spark.createDataFrame([(f"d{k}", "one two three") for k in range(200)], "doc_id string, text string")
    assert {r.form for r in M.fill_in_middle(texts, rate=100, spm_rate=0).collect()} == {"psm"}
    assert {r.form for r in M.fill_in_middle(texts, rate=0).collect()} == {"plain"}
    assert M.fill_in_middle(texts.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a b c", "<", "", "x <M> y"])
def test_sql_agrees(text):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(k, f"{text} {k}" if k % 9 else text) for k in range(60)])
    rows = con.execute(f"select doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 from ({M.SQL})").fetchall()
    texts = dict(con.execute("select * from documents").fetchall())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, *rest, output, back in rows:
        *numbers, said = plain(i, texts[i])
        assert rest == numbers and output == sha(said) and back == sha(texts[i])
