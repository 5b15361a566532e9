import random
import re

from loquat.llm import jaccard_join as J


def brute(rows, size=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root(x), root(y)))
                    up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(30)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "a b c"), (6, "A b\nC"), (7, "x " * 5000)]
    for i in range(len(rows), n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return rows


def test_components(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, n int")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_documents(df).collect()}
        assert got == brute(rows)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "a b c d e")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in J.link_documents(df).collect()))) == sorted(map(str, [(None, 2, None), (4, 2, 4), (4, 2, 4), (9, 2, 4)]))
    assert J.link_documents(df.filter("false")).count() == 0


def brute_links(rows, size=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    out = dict.fromkeys(sets, 0)
    for x in sets:
        for y in sets:
            if x != y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                out[x] += den * both >= num * (len(sets[x]) + len(sets[y]) - both)
    return out


def test_number_of_links(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.link_documents(df, links=True).collect()}
    links = brute_links(rows)
    assert any(links.values()) and got == {i: (*x, links[i]) for i, x in brute(rows).items()}
    named = J.link_documents(df.selectExpr("concat('d', doc_id) AS doc_id", "text"), links=True)
    assert {r.doc_id: r.n_links for r in named.collect()} == {f"d{i}": n for i, n in links.items()}


def test_number_of_links_of_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "a b c d e"), (5, ""), (6, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_links) for r in J.link_documents(df, links=True).collect())
    assert got == [("4", 1), ("4", 1), ("5", 0), ("6", 0), ("9", 1), ("None", None)]
    assert J.link_documents(df.filter("false"), links=True).count() == 0
