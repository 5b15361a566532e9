import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loquat.llm import substring_dedup as S


def brute(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=90):
    rng = random.Random(seed)
    words = [a + b for a in "the of añd zu éé ha".split() for b in ("", "ing", "ß", "x1", "…")]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [say(rng.randint(20, 60)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 900), (4, "z" * 700), (5, "z" * 100), (6, "z" * 99)]
    for i in range(len(rows), n):
        kind = rng.random()
        text = say(rng.randint(5, 200))
        if kind < 0.3:
            text = text + " " + rng.choice(passages) + " " + say(rng.randint(0, 30))
        elif kind < 0.6:
            text = rng.choice(rows[3:])[1] or ""
            w = text.split(" ")
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        rows.append((i, text))
    return rows


def result(df, **kw):
    return {r.doc_id: (r.n_bytes, sum(x.end - x.begin for x in r.removed), len(r.removed), r.kept_sha256) for r in S.remove_repeats(df, **kw).collect()}


@pytest.mark.parametrize("seed,wide", [(1, 256), (2, 1), (3, 256), (4, 3)])
def test_against_brute_force(spark, seed, wide):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, doc long, spans string").repartition(5)
    assert result(df, wide=wide) == brute(rows, 100)


def test_interval_expansion_groups_equal_strings():
    rng = np.random.default_rng(5)
    for length in (3, 9, 20):
        text = np.concatenate([rng.integers(97, 99, 400), np.full(60, 97), rng.integers(97, 99, 200)]).astype(np.uint8)
        text = np.concatenate([text, text[100:300], [255]]).astype(np.uint8)
        order, group = S.interval_expansion(text, length)
        twice = np.concatenate([text, text])
        strings = [twice[k : k + length].tobytes() for k in order]
        assert strings == sorted(strings)
        assert group.tolist() == np.cumsum([0] + [a != b for a, b in zip(strings, strings[1:], strict=False)]).tolist()


def test_repeated_and_null_ids_and_empty(spark):
    text = "word number one and two " * 3 + "".join(chr(97 + i % 26) + str(i) for i in range(80))
    rows = [(None, text), (4, text), (4, text), (7, text + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(text)
    got = sorted((str(r.doc_id), r.n_bytes, sum(x.end - x.begin for x in r.removed)) for r in S.remove_repeats(df).collect())
    assert got == sorted([("None", n, 0), ("4", n, n), ("4", n, n), ("7", n + 1, n)])
    assert S.remove_repeats(df.filter("false")).count() == 0


def test_long_document(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdef \n") for _ in range(1_300_000))
    text = text + text[1000:1500]
    df = spark.createDataFrame([(1, text), (2, text[600_000:600_400])], "doc_id long, text string")
    got = result(df, with_text=True)
    assert got[1][1:3] == (500, 1) and got[2][1:3] == (400, 1)


def test_many_near_copies_of_one_passage(spark):
    """Every word of the passage is replaced somewhere, so all its anchors have far more contexts than one comparison takes."""
    rng = random.Random(21)
    passage = [f"{rng.choice('bdklmnrst')}{rng.choice('aeiou')}{rng.choice('bdklmnrst')}{k}" for k in range(45)]
    rows = []
    for i in range(10_000):
        w = list(passage)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"other{rng.randrange(400)}"
        rows.append((i, f"document {i} says: " + " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows, 100)
    assert result(df, wide=64) == want
    assert result(df) == want


def test_settling_in_order_is_the_same_in_any_batches():
    rng = np.random.default_rng(4)
    rows = np.array(sorted({(int(rng.integers(0, 9)) ** 2, int(rng.integers(0, 40)), int(rng.integers(0, 30)), 1 << 16 | 3) for _ in range(700)}), np.int64)
    rows = np.concatenate([rows, rows[::7]])
    rows = rows[np.lexsort(rows.T[::-1])]

    def run(cut):
        parts = [rows[k : k + cut] for k in range(0, len(rows), cut)]
        got = S._settled((S.batch(h=pa.array(x[:, 0]), ctx=pa.array(x[:, 1]), doc=pa.array(x[:, 2]), span=pa.array(x[:, 3])) for x in parts), 20)
        return sorted(str(r) for b in got for r in b.to_pylist())

    assert run(1) == run(13) == run(10_000)


def test_other_ids_and_clashing_columns(spark):
    rows = [(i, t) for i, t in corpus(5, 40)]
    names = ["doc", "h", "ctx", "span", "spans", "digest", "bytes", "removed", "n_bytes", "kept", "asked", "key"]
    df = spark.createDataFrame([(f"d{i:03}", t, *[1] * len(names)) for i, t in rows], "doc_id string, text string, " + ", ".join(f"{n} int" for n in names))
    assert {int(k[1:]): v for k, v in result(df).items()} == brute(rows, 100)
