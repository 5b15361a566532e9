import numpy as np

from loquat.llm import ann as A


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        far = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = far[:k]
    return out


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    codes[100:130] = codes[0]
    index = A.index_of(codes)
    for radius in (0, 3, 7, 12, 32):
        got = A.probe(index, codes, codes[0], radius)
        assert got.tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[0]).sum(1) <= radius).tolist()


def test_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 24))).tolist()
    for k in range(100, 130):
        x[k] = x[0]  # a group of equal vectors
    rows = list(enumerate(x))
    bad = [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [1.0, None] + [0.0] * 22), (5400, [float("inf")] + [0.0] * 23), (5500, [1.0, 2.0]), (None, x[3])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int, score double").repartition(5)
    queries = df.filter("vec_id % 100 = 0")
    got = {}
    for r in A.search(df, queries, "vec_id", "embedding").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11))
        hits += len({i for *_, i in found} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.9
    assert [i for *_, i in got[100]] == [0, *range(101, 110)] and got[100][0][1] == 0.0


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.5, 2.0]), (2, [5.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in A.search(df, df.filter("vec_id = 0"), "vec_id", "embedding").collect()]
    assert sorted(got) == [(0, 1, 1, 0.5), (0, 2, 2, 20**0.5)]
    assert A.search(df.filter("false"), df, "vec_id", "embedding").count() == 0


def test_blocks_of_rows_and_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16))
    x[300:600] = x[0]  # a third of the rows are equal
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(5)
    run = lambda: sorted(map(tuple, A.search(df, df.filter("vec_id % 9 = 0"), "vec_id", "embedding").collect()))
    plain = run()
    monkeypatch.setattr(A, "BLOCK_QUERIES", 7)
    assert run() == plain and len(plain) == 1000
    found = {}
    for q, _, i, _ in plain:
        found.setdefault(q, []).append(i)
    assert all(found[q] == [i for i in [0, *range(300, 600)] if i != q][:10] for q in (0, 306, 594))


def test_queries_that_repeat(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [3.0, 0.0]), (1, [1.5, 0.0]), (1, [9.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in A.search(df, df.filter("vec_id = 0"), "vec_id", "embedding").collect()]
    assert sorted(got) == [(0, 1, 1, 0.5), (0, 2, 1, 8.0)]


def test_recall_at_table_scale(spark):
    """Nearly isotropic vectors, the hardest for codes."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in A.search(df, df.filter("vec_id % 500 = 0"), "vec_id", "embedding").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 500):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(got[q] & set(np.argsort(far)[:10].tolist()))
    assert hits / 400 >= 0.93
