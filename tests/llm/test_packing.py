import zlib

import numpy as np
import pytest

from loquat.llm import packing as P


def plain_bfd(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(window - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = 64
    lengths = rng.integers(1, window, 700) if seed % 2 else rng.choice([3, 7, 20, 33, 50], 400)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    steps, windows = P.best_fit_decreasing(histogram, window)
    assert windows == plain_bfd(lengths.tolist(), window)
    used, seen = {}, {}
    for length, at, count, first, each, offset in steps.tolist():
        for i in range(count):
            assert seen.setdefault((length, at + i), True) is True
            used.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert len(seen) == len(lengths)
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window


def test_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "a b c " * 3000, "the cat\n\tsat, 12 times…", "漢字 mixed", "x<|endoftext|>y", "dup", "dup"] + [f"line {i} " * (i % 37) for i in range(200)]
    rows = [(i if i != 3 else None, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string, length long")
    out = P.pack_documents(df, with_ids=True).collect()
    whole = Tokenizer.from_file(P.public_spec()[0])
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    got, windows = {}, {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        got.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in got.items():
        ids = [x for _, p, _ in sorted(pieces) for x in p]
        assert ids == want[i] and all(n == len(ids) for *_, n in pieces)
    assert got.keys() == want.keys()
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= P.WINDOW
    assert sorted(windows) == list(range(len(windows)))


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_of_blanks(spark):
    from tokenizers import Tokenizer

    whole, coder = Tokenizer.from_file(P.public_spec()[0]), P.tokenizer(*P.public_spec())
    for text in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", " " * 10_000, " " * 10_001, "x " + " \t" * 6_000 + "y"):
        assert coder.ids(text) == whole.encode(text, add_special_tokens=False).ids
    out = P.pack_documents(spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000)], "doc_id long, text string"))
    assert {(r.doc_id, r.doc_tokens) for r in out.collect()} == {(1, 1_000_001), (2, 500_001)}


def test_both_ways_give_the_same_ids():
    import random

    from tokenizers import Tokenizer

    whole, coder, rng = Tokenizer.from_file(P.public_spec()[0]), P.tokenizer(*P.public_spec()), random.Random(5)
    for _ in range(3_000):
        text = "".join(chr(rng.randrange(0x250)) if rng.random() < 0.5 else rng.choice(" abc'sdlt\n\t0123") for _ in range(rng.randrange(40)))
        assert coder.ids(text) == whole.encode(text, add_special_tokens=False).ids
