import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from loquat.llm import alignment as A

FOLDER = "/root/testdata/sf0.001"


def ends(pieces):
    at, out = 0, []
    for p in pieces:
        at += len(p)
        out.append(at)
    return out


def brute(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) and the counts, with plain loops over the libraries."""
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    alphabet, entries = A._byte_alphabet(), {k: v for v, k in a.get_vocab().items()}
    docs, counts = [], Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(alphabet[c] for c in entries[k]) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        common = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for e in common:
            to_i, to_j = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, ids_a[i:to_i])) + "|" + ",".join(map(str, ids_b[j:to_j])))
            i, j = to_i, to_j
        of_a, of_b = dict(zip(ends_a, ids_a, strict=True)), dict(zip(ends_b, ids_b, strict=True))
        links = [(of_a[e], of_b[e]) for e in common]
        counts.update(links)
        docs.append((ids_a, ids_b, groups, links))
    best = Counter()
    for (_, kb), n in counts.items():
        best[kb] = max(best[kb], n)
    return [(len(x), len(y), len(g), len(ls), sum(counts[k] == best[k[1]] for k in ls), sum(counts[k] for k in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for x, y, g, ls in docs], counts, best


def made():
    rng = random.Random(13)
    parts = ["the", " cat", " été", "ing", "\n", "\n\n", "\t", "  ", "漢字", "𝔘", "…", "▁", "x" * 9, "0", "12345", ".", ",", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "é", "ñ", "\x00", "\xa0", "Straße", "'s", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [*texts, None, "", " ", "  lead", "trail  ", "the cat sat on the mat. " * 300, *["same again, and again"] * 30]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    texts = made()
    if small:  # many batches and parts
        monkeypatch.setattr(A, "PART_LEAST", 40)
        monkeypatch.setattr(A, "PART_LINKS", 50)
    rows = [(k if k % 60 else None, t, 1, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, k long").repartition(3)
    out, pairs = A.align_tokenizers(df.withColumn("doc_id", df.k))
    want, counts, best = brute([t or "" for t in texts])
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()}
    assert len(got) == len(texts)
    for k, row in enumerate(want):
        assert got[k] == row, (k, texts[k])
    assert any(row[0] for row in want) and any(t and not row[0] for t, row in zip(texts, want, strict=True))
    assert {(r.a_id, r.b_id): (r["count"], r.is_best) for r in pairs.collect()} == {k: (n, n == best[k[1]]) for k, n in counts.items()}


def test_batches_within_a_task():
    import pyarrow as pa

    spec, texts = A.public_vocabularies(), [t or "" for t in made()]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(range(len(texts)))], names=["row", "text", "id"])
    size = len(A.aligner(*spec).bytes_a)
    width = A.STRIPE * size
    before, A.BATCH_LINKS = A.BATCH_LINKS, 500
    try:
        made_rows = pa.Table.from_batches(list(A._aligned(iter([whole]), spec))).combine_chunks().to_batches()[0]
    finally:
        A.BATCH_LINKS = before
    assert len(set(made_rows.column("batch").to_pylist())) > 5
    tally = pa.Table.from_batches(list(A._tallied(iter([made_rows.select(["links"])]), "<u4", width))).sort_by("stripe").combine_chunks().to_batches()[0]
    counted = pa.Table.from_batches(list(A._counted(iter([tally]), size, A.STRIPE)))
    first = np.arange(-(-32000 // A.STRIPE))
    links = made_rows.select(["batch", "place", "links"])
    parts = [p for b in A._dealt(iter([links]), "<u4", width, first, np.ones(len(first), np.int64)) for p in b.to_pylist()]
    copies = [{"part": r["stripe"], "kind": 2 * r["stripe"], "batch": None, "places": r["best"], "pairs": r["pairs"], "sums": r["sums"]} for r in counted.to_pylist()]
    dealt = pa.Table.from_pylist(sorted(copies + parts, key=lambda r: (r["part"], r["kind"])), pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("places", pa.binary()), ("pairs", pa.binary()), ("sums", pa.binary())])).to_batches()
    scored = pa.Table.from_batches(list(A._scored(iter(dealt), size, A.STRIPE))).sort_by("batch").to_batches()
    got = {(r["batch"], r["place"]): (r["n_best"], r["count_sum"]) for b in A._summed(iter(scored)) for r in b.to_pylist()}
    want, *_ = brute(texts)
    for r, w in zip(made_rows.to_pylist(), want, strict=True):
        assert got.get((r["batch"], r["place"]), (0, 0)) == w[4:6]


def test_parts():
    loads = np.array([0, 5, 30, 0, 101, 3, 3, 3, 9, 10, 0, 25])
    first, parts, n = A._parts(loads, 10)
    share = {}
    for s, load in enumerate(loads):
        for k in range(parts[s]):
            share[first[s] + k] = share.get(first[s] + k, 0) + load / parts[s]
    assert max(share.values()) <= 10 and max(share) == n - 1 and sum(share.values()) == pytest.approx(loads.sum())
    assert A._parts(np.zeros(4, np.int64), 10)[2] == 1


def test_empty_and_odd_ids(spark):
    assert A.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
    out = A.align_tokenizers(spark.createDataFrame([(None, "a b"), ("x", "a b"), ("x", "a b"), ("y", None)], "doc_id string, text string"))[0].collect()
    assert sorted((str(r.doc_id), r.n_links, r.count_sum) for r in out) == [("None", 2, 6), ("x", 2, 6), ("x", 2, 6), ("y", 0, 0)]


def test_long_text():
    both = A.aligner(*A.public_vocabularies())
    for text in ("ab " * 300_000, " " * 300_000, "z" * 300_000):
        n_a, n_b, _, links = both.align(text, both.pieces.encode(text))
        assert n_a and n_b and len(links)


def test_query(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in A.query(spark, FOLDER).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, brute([r.text or "" for r in rows])[0], strict=True)}
