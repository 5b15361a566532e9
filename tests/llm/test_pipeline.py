import random

import corpus_pipeline as C

from loquat.llm import packing


def tables(spark, folder):
    rng = random.Random(8)
    words = [a + b + c for a in "ba ke lo mu ni".split() for b in "ra so ti vu".split() for c in ("", "na", "zu")]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(k, say(30) + ".") for k in range(60)]
    docs, labels, kinds = [], [], {}
    for i in range(420):
        text, kind = "\n".join(say(rng.randint(6, 20)) for _ in range(rng.randint(2, 6))), "clean"
        if i % 7 == 0:
            text, kind = " ".join(w + "***" for w in text.split(" ")), "junk"
        elif i % 11 == 0:
            text, kind = text + "\n" + items[i % 60][1], "leak"
        elif i % 5 == 0 and i > 20:
            text, kind = next(t for j, t in docs if kinds[j] == "clean" and j > i - 20) + " extra", "copy"
        elif i % 3 == 0:
            text = say(9) + "\nAll rights to this page are reserved by us\n" + text
        kinds[i] = kind
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(kind != "junk"), 0))
    docs += [(1000, None), (1001, ""), (None, say(60)), (1002, say(9000))]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(docs), kinds


def test_stages_in_turn(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts, kinds = tables(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, step in C.STAGES[:-1]:
        step(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    of = lambda kind, kept: sum(kinds.get(i) == kind for i in kept)
    total = {k: list(kinds.values()).count(k) for k in set(kinds.values())}
    assert of("junk", seen[0]) <= 0.1 * total["junk"] and of("clean", seen[0]) >= 0.95 * total["clean"]
    assert len(seen[1]) == len(seen[0]) and not any("reserved by us" in (t or "") for t in seen[1].values())
    assert of("copy", seen[2]) <= 0.15 * total["copy"] and of("clean", seen[2]) >= 0.97 * of("clean", seen[1])
    assert of("leak", seen[3]) == 0 and of("clean", seen[3]) == of("clean", seen[2])
    assert {1000, 1001, 1002, None} & set(seen[0]) == {1000, 1001, 1002, None} & set(seen[3])
    pieces = C.run(spark, folder).collect()
    coder, got = packing.tokenizer(*packing.public_spec()), {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(coder.ids(t or "")) + 1 for i, t in seen[3].items()}


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert C.run(spark, folder).count() == 0
