import random

import numpy as np

from loquat.llm import decontaminate as D


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 80)), rng.integers(0, 6, rng.integers(0, 90))
        assert D.common_subsequence(a, b) == plain_lcs(a.tolist(), b.tolist())


def corpus():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "ba ke lo mu ni ra so ti vu éz".split() for b in "ba ke lo mu ni ra so ti vu xa".split()]
    common = ["the", "of", "and", "to"]
    say = lambda k: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) + str(rng.randint(0, 300)) for _ in range(k)]
    items = [(k, " ".join(say(rng.randint(20, 55))) + ". " + " ".join(say(7)) + ".") for k in range(30)]
    items += [(30, None), (31, "?!"), (32, "one of"), (3, items[4][1])]
    docs, want = [(0, None), (1, ""), (2, "one")], set()
    for i in range(3, 240):
        w = say(rng.randint(1, 400))
        if i % 6 == 0:
            k = rng.randrange(30)
            own = items[k][1].replace("."," ").split()
            kind = i % 4
            if kind == 2:  # a third of the words but those of the answer replaced
                own = [x if n >= len(own) - 7 or n % 3 else "other" for n, x in enumerate(own)]
            at = rng.randint(0, len(w))
            w = w[:at] + [x.upper() if kind == 0 else x + "," for x in own] + w[at:]
            want |= {(i, k)} | ({(i, 3)} if k == 4 else set())
        docs.append((i, " ".join(w)))
    return docs, items, want


def test_verbatim_and_paraphrased_leaks(spark):
    docs, items, want = corpus()
    d = spark.createDataFrame([(*r, 0.0, 1) for r in docs], "doc_id long, text string, lcs double, item_id int").repartition(3)
    got = D.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.lcs >= D.LOOSE for r in got)


def test_empty(spark):
    docs, items, _ = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.find_leaks(d.filter("false"), b).count() == 0
    assert D.find_leaks(d, b.filter("false")).count() == 0
    assert D.find_leaks(d, b.filter("text is null")).count() == 0


def test_item_that_many_short_documents_leak(spark):
    rng = random.Random(9)
    pool = [f"w{k}" for k in range(2500)]
    say = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    hot = {0: [f"rare{k}" for k in range(15)], 1: [f"odd{k}" for k in range(30)]}
    items = [(k, " ".join(hot[k][:-5]) + ". " + " ".join(hot[k][-5:]) + ".") for k in hot] + [(k, say(rng.randint(20, 50))) for k in range(2, 200)]
    docs, want = [], set()
    for i in range(600):
        w = say(120).split()
        if i % 3 < 2:
            at, own = rng.randint(0, len(w)), list(hot[i % 3])
            if i % 4 == 0:  # every third word replaced, but for the last five
                own = [x if n >= len(own) - 5 or n % 3 else "other" for n, x in enumerate(own)]
            w = w[:at] + own + w[at:]
            want.add((i, i % 3))
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(d, b).collect()}
    assert got == want, (len(got), len(want), len(want - got))


def test_items_longer_than_a_passage(spark):
    rng = random.Random(12)
    pool = [f"w{k}" for k in range(4000)]
    say = lambda k: [rng.choice(pool) for _ in range(k)]
    sizes = [20, 40, 64, 65, 128, 160, 200, 300, 500]
    texts = [say(sizes[k % len(sizes)]) for k in range(36)]
    items = [(k, " ".join(w[:-7]) + ". " + " ".join(w[-7:]) + ".") for k, w in enumerate(texts)]
    docs, want = [], set()
    for i in range(216):
        w, own = say(rng.randint(0, 700)), list(texts[i % 36])
        if i % 5 == 0:  # a third of the words replaced, but for the last seven
            own = [x if n >= len(own) - 7 or n % 3 else "other" for n, x in enumerate(own)]
        if i % 2:
            at = rng.randint(0, len(w))
            w = w[:at] + own + w[at:]
            want.add((i, i % 36))
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(d, b).collect()}
    assert got == want, (len(got), len(want), len(want - got))


def test_an_item_is_judged_whatever_the_others_are(spark, monkeypatch):
    """Words of a short item that are strewn over a text are no leak, beside a long item or without one; nor do blocks of items matter."""
    rng = random.Random(17)
    pool = [f"w{k}" for k in range(900)]
    say = lambda k: [rng.choice(pool) for _ in range(k)]
    short = [f"rare{k}" for k in range(12)]
    strewn = say(16)
    for word in short:
        strewn += [word, *say(11)]
    docs = [(0, " ".join(strewn)), (1, " ".join([*say(30), *short, *say(30)]))] + [(k, " ".join(say(rng.randint(5, 200)))) for k in range(2, 60)]
    items = [(0, " ".join(short)), (1, " ".join(say(600)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    alone = [(r.doc_id, r.item_id) for r in D.find_leaks(d, b.filter("item_id = 0")).collect()]
    both = [(r.doc_id, r.item_id) for r in D.find_leaks(d, b).collect()]
    monkeypatch.setattr(D, "ITEMS", 1)
    blocks = [(r.doc_id, r.item_id) for r in D.find_leaks(d, b).collect()]
    assert alone == both == blocks == [(1, 0)]


def brute(docs, items):
    """Every item against every stretch of every document."""
    out = set()
    for k, item in items:
        own = D.words_of((item or "").lower()).tolist()
        answer = D.answer_of((item or "").lower()).tolist()
        for i, text in docs:
            h = D.words_of((text or "").lower()).tolist()
            for at in range(0, max(1, len(h) - D.LOOSENESS * len(own) + 1), max(1, len(own) // 4)) if own else ():
                part = h[at : at + D.LOOSENESS * len(own)]
                if sum(w in set(own) for w in part) < D.LOOSE * len(own):
                    continue
                share = plain_lcs(own, part) / len(own)
                if share >= (D.LCS if len(own) >= D.LEAST else 1.0) or len(own) >= D.LEAST and share >= D.LOOSE and plain_lcs(answer, part) >= D.LCS * len(answer):
                    out.add((i, k))
    return out


def test_query_against_brute_force(spark, tmp_path):
    docs, items, want = corpus()
    assert brute(docs, items) == want
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in D.query(spark, f"file://{tmp_path}").collect()} == want


def test_long_text_null_and_other_ids(spark):
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(5000)]
    say = lambda k: [rng.choice(pool) for _ in range(k)]
    items = [(k, " ".join(say(40))) for k in range(50)]
    long = say(90_000)
    long[70_000:70_000] = items[7][1].split()
    rows = [("a", " ".join(long)), (None, "so " + items[3][1]), ("b", items[3][1]), ("b", items[3][1]), ("c", " ".join(say(90)))]
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id string, text string, item_id int, weight int, block int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, bucket int")
    assert sorted((r.doc_id or "", r.item_id) for r in D.find_leaks(d, b).collect()) == [("", 3), ("a", 7), ("b", 3), ("b", 3)]


def test_basis_is_fitted_on_all_documents(spark, monkeypatch):
    """The basis holds as much of all passages as the exact singular vectors do; copies of a text count as one."""
    rng = np.random.default_rng(8)
    pool = np.array([f"w{k}" for k in range(400)])
    say = lambda k: " ".join(rng.choice(pool, k, p=np.arange(1, 401) / 80200))
    texts = [say(int(rng.integers(1, 150))) for _ in range(4_500)] + ["one text of its own w1 w2 w3"] * 1_500
    items = [say(30) for _ in range(40)]
    real, seen = D.latent_basis, []

    def spied(rows, of, vocabulary, *rest):
        seen.extend([rows.count(), rows.groupBy().sum("weight").first()[0], of.first().weight, vocabulary, real(rows, of, vocabulary, *rest)])
        return seen[-1]

    monkeypatch.setattr(D, "latent_basis", spied)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    D.find_leaks(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    rows, total, weight, vocabulary, basis = seen
    assert rows == len(texts) + len(items) and abs(total - 4_501 - weight * len(items)) < 1e-3 * total
    square = np.zeros((vocabulary.size, vocabulary.size))
    for t, w in [(t, 1.0) for t in texts[:4_501]] + [(t, weight) for t in items]:
        words = D.words_of(t)
        for k in range(0, len(words), D.PASSAGE):
            a = np.zeros(vocabulary.size)
            np.add.at(a, vocabulary.known(words[k : k + D.PASSAGE])[1], 1)
            a *= vocabulary.weight
            each = np.sqrt((vocabulary.weight[vocabulary.known(words[k : k + D.PASSAGE])[1]] ** 2).sum())
            square += w * np.outer(a, a) / each**2 if each else 0
    best = np.linalg.eigvalsh(square)[::-1][: basis.shape[1]].sum()
    assert basis.shape[1] == D.RANK and np.allclose(basis.T @ basis, np.eye(D.RANK), atol=1e-4)
    assert np.trace(basis.T @ square @ basis) > 0.98 * best
