"""Packing: best-fit decreasing of tokenised documents into fixed windows.

``pack_documents`` tokenises every whole text, cuts overlong documents into full
windows and packs what remains best-fit decreasing: pieces go longest first, each
into the open window with the least room that still holds it. A segment tree over
the remaining capacity (0 .. window) finds that window.

Best-fit decreasing looks only at lengths, and pieces of one length are alike, so
the plan is made on the histogram of piece lengths (at most ``window`` numbers,
whatever the input): the tree's leaves hold *ranges* of windows with the same room.
Each step of the plan gives a range of equal pieces to a range of windows. A window
holds pieces of fewer than ``sqrt(2 * window)`` different lengths and every length
splits at most two ranges, so the plan is bounded too. Pieces learn their ordinal
among those of their length from per-block counts, never from a sort of all pieces.

Defined cases: null text is empty and has the end token only; a null ``doc_id`` is
kept as it is; repeated rows are packed each on its own (ties of ``doc_id`` are
broken by piece start and text digest); a text of any length is tokenised whole, runs of
blanks of any length too; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, table

WINDOW = 2048
END_ID = 1
#: Pieces per block in which ordinals are given.
BLOCK_PIECES = 20_000


class _Tokenizer:
    """Ids of the byte-level BPE file.

    Texts of letters below U+0250 go through the same vocabulary as ranks, which is several times faster and gives the same
    ids. Others go through the file itself, as do texts that spell the special token (unless ``plain_specials`` says that
    it is text like any other) and those with over ``BLANKS`` blanks in a row, for which the fast library's stack is too small.
    """

    FAR = re.compile("[^\x00-ɏ]")
    SPECIAL = "<|endoftext|>"
    RUN = re.compile(r"\s{64,}")
    BLANKS = 10_000

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain_specials
        self.plain_specials = plain_specials
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not self.FAR.search(text) and (self.plain_specials or self.SPECIAL not in text) and not (len(text) > self.BLANKS and any(m.end() - m.start() > self.BLANKS for m in self.RUN.finditer(text))):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


_loaded: dict[tuple, _Tokenizer] = {}


def tokenizer(*spec) -> _Tokenizer:
    if spec not in _loaded:
        _loaded[spec] = _Tokenizer(*spec)
    return _loaded[spec]


def public_spec() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


# ---- the plan -------------------------------------------------------------


class RoomTree:
    """A segment tree over remaining capacities: which of them has an open window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, room: int, there: bool) -> None:
        k = room + self.leaves
        self.any[k] = there
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] | self.any[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that has a window."""
        k = least + self.leaves
        if self.any[k]:
            return least
        while k > 1:
            if not k & 1 and self.any[k + 1]:  # the right sibling holds larger rooms only
                k += 1
                while k < self.leaves:
                    k = 2 * k + (not self.any[2 * k])
                return k - self.leaves
            k >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Plan steps (length, first ordinal, pieces, first window, pieces to a window, offset) and the number of windows."""
    tree, rooms, steps, windows = RoomTree(window), {}, [], 0

    def put(room: int, first: int, count: int) -> None:
        rooms.setdefault(room, []).append((first, count))
        tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        at, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                first, count, room = windows, -(-left // (window // length)), window
                windows += count
            else:
                first, count = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            each = room // length
            full = min(count, left // each)
            if full:
                steps.append((length, at, full * each, first, each, window - room))
                put(room - each * length, first, full)
                at, left, first, count = at + full * each, left - full * each, first + full, count - full
            if left and count:
                steps.append((length, at, left, first, left, window - room))
                put(room - left * length, first, 1)
                at, left, first, count = at + left, 0, first + 1, count - 1
            if count:
                put(room, first, count)
    return np.array(steps, np.int64).reshape(-1, 6), windows


# ---- the operator ---------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch], spec: tuple, window: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    coder = tokenizer(*spec)
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"] + ["ids"] * with_ids
    for rows in batches:
        for part in range(0, rows.num_rows, 256):
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(*(c.to_pylist() for c in rows.slice(part, 256).columns), strict=True):
                ids = np.array([*coder.ids(text or ""), end_id], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    for column, value in zip(out, (doc_id, start, len(piece), len(ids), zlib.crc32(piece.tobytes()), piece), strict=False):
                        column.append(value)
            kinds = [rows.schema.field(0).type, *[pa.int64()] * 4, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=False)], names=names)


def _placed(batches: Iterator[pa.RecordBatch], steps: np.ndarray, windows: int, window: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    length, begin, _, first, each, offset = steps[order].T
    span = int(begin.max(initial=0)) + 1
    keys = [int(a) * span + int(b) for a, b in zip(length, begin, strict=True)]
    keys = np.array(keys, np.int64 if not keys or keys[-1] < 1 << 62 else object)
    for rows in batches:
        n = rows.column("length").to_numpy()
        ordinal = rows.column("ordinal").to_numpy()
        whole = n == window
        at = np.maximum(np.searchsorted(keys, n.astype(keys.dtype) * span + np.minimum(ordinal, span - 1), "right") - 1, 0)
        if len(keys):
            inside = ordinal - begin[at]
            sequence = np.where(whole, windows + ordinal, first[at] + inside // each[at])
            place = np.where(whole, 0, offset[at] + inside % each[at] * n)
        else:
            sequence, place = windows + ordinal, np.zeros(len(n), np.int64)
        names = [x for x in rows.schema.names if x != "ordinal"]
        yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in names), pa.array(sequence), pa.array(place)], names=[*names, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, spec: tuple | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32 [, ids], sequence_id, offset.

    ``spec`` is (tokenizer file, the same vocabulary as ranks or None, its pattern or None).
    """
    spark, spec = docs.sparkSession, spec or public_spec()
    stage = Stage(spark, "pack")
    id_type = docs.schema[id_col].dataType.simpleString()
    wide = f"doc_id {id_type}, start long, length long, doc_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _pieces(it, spec, window, end_id, with_ids), wide)
    pieces = stage.write(pieces, "pieces")
    blocks = max(1, -(-pieces.count() // BLOCK_PIECES))
    digest = F.xxhash64("doc_id", "start", "ids_crc32")
    pieces = pieces.withColumn("block", F.pmod(digest, F.lit(blocks)))
    counts = stage.write(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    # the histogram has at most ``window`` rows
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, windows = best_fit_decreasing({k: v for k, v in histogram.items() if k < window}, window)
    within = F.row_number().over(W.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("ordinal", within.cast("long")).join(before, ["length", "block"]).withColumn("ordinal", F.col("ordinal") + F.col("before"))
    names = [*(x.split()[0] for x in wide.split(", "))]
    return ranked.select(*names, "ordinal").mapInArrow(lambda it: _placed(it, steps, windows, window), f"{wide}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
