import itertools
import random
import zlib

import numpy as np

from loquat.llm import quality as Q


def corpus(n=700):
    rng = random.Random(3)
    words = ["the", "of", "house", "river", "stone", "walks", "slowly", "and", "zürich", "été"]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        k = rng.randint(5, 80)
        text = " ".join(rng.choice(words) for _ in range(k)) if good else " ".join(rng.choice(words) + rng.choice(["***", "$$$", "!!"]) for _ in range(k))
        docs.append((i, text, "en", 1.0))
        if i % 2 == 0:
            labels.append((i, int(good)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (None, "the river", "en", 0.0), (n + 2, "stone " * 60000, "en", 0.0)]
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3)
    l = spark.createDataFrame([*labels, (1, None), (3, 9), (10**9, 1), (None, 0)], "doc_id long, quality int")
    rows = Q.score_documents(d, l).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", Q.held_out("doc_id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)} | {None: False}


def test_one_kind_of_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score_documents(docs, none).collect()] == [0.5, 0.5]
    assert Q.score_documents(docs.filter("false"), none).count() == 0


def test_temperature_is_fitted():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(1500, 4)), np.full(1500, 5.0)].astype(np.float32)
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    score = Q.Network(x, y).score(x)
    for lo, hi in ((0.1, 0.3), (0.7, 0.9)):
        inside = (score > lo) & (score < hi)
        assert abs(y[inside].mean() - score[inside].mean()) < 0.12


def plain_tokens(text):
    """Runs of letters and digits, or of other marks, in bytes."""
    kind = lambda b: 0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2
    return [bytes(run) for k, run in itertools.groupby((text or "").encode(), kind) if k]


def plain_features(texts):
    """Vectors and pooled features of the documents, word by word."""
    mask, rows, often = (1 << 64) - 1, {}, {}

    def hashed(word):
        raw = np.frombuffer(word, np.uint8)
        return int(Q.word_hashes(raw, np.array([0, len(raw)]), *Q.byte_classes(Q._SPACE, lower=False), Q._KINDS)[0][0])

    def index(h):
        g = int(Q.mix(np.array([(h + 0x632BE59BD9B4E019) & mask], np.uint64))[0])
        return [((g >> 8 * k) & (Q.DIMS - 1), 1 - 2 * ((g >> (40 + k)) & 1)) for k in range(2)]

    docs = [[hashed(w) for w in plain_tokens(t)] for t in texts]
    for words in docs:
        for i, h in enumerate(words):
            row = h & ((1 << Q.ROW_BITS) - 1)
            often[row] = often.get(row, 0) + 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    for place, sign in index(words[j]):
                        rows.setdefault(row, np.zeros(Q.DIMS))[place] += sign
    total = sum(often.values())
    unit = {}
    for row in often:
        v = rows.get(row, np.zeros(Q.DIMS))
        v = np.sign(v) * np.log1p(np.abs(v))
        unit[row] = v / max(np.linalg.norm(v), 1e-9)
    out = []
    for words in docs:
        x = np.zeros(3 * Q.DIMS + 1)
        if words:
            keys = [h & ((1 << Q.ROW_BITS) - 1) for h in words]
            w = np.array([1e-3 / (1e-3 + often[r] / total) for r in keys])
            v = np.array([unit[r] for r in keys])
            mean = (w[:, None] * v).sum(0) / w.sum()
            spread = np.sqrt(np.maximum((w[:, None] * v * v).sum(0) / w.sum() - mean**2, 0))
            x = np.concatenate([mean, spread, (v[:-1] * v[1:]).sum(0) / max(len(v) - 1, 1), [np.log1p(len(v))]])
        out.append(x)
    return np.array(out)


def test_features_against_plain_loops(spark):
    docs, _ = corpus(60)
    texts = [t for _, t, *_ in docs][:-1]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    vectors, weights = Q.word_vectors(df)
    raw = b"".join((t or "").encode() for t in texts)
    off = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    got = Q.pooled(np.frombuffer(raw, np.uint8), off, vectors, weights)
    assert np.abs(got - plain_features(texts)).max() < 2e-3


def test_one_id_that_stands_in_most_rows(spark):
    docs = [(1, f"river {k} stone") for k in range(500)] + [(k, "the house") for k in range(2, 60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, quality int")
    assert Q.score_documents(d, l).count() == len(docs)


def test_kept_columns(spark):
    docs, labels = corpus(80)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    every = {str(r.doc_id): (r.text, r.lang, r.score) for r in Q.score_documents(d, l).collect()}
    some = Q.score_documents(d, l, keep=["doc_id"])
    assert some.columns == ["doc_id", "score"] and {str(r.doc_id): r.score for r in some.collect()} == {k: v[2] for k, v in every.items()}
    assert {str(i): t for i, t, *_ in docs} == {k: v[0] for k, v in every.items()}
