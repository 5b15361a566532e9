"""Suffix-array dedup: every byte of a 100-byte string that also starts earlier is removed.

"Earlier" is a smaller document id, or the same document and a smaller start. Texts are their UTF-8 bytes and
matches never cross documents. The result is exact; strings are judged on the input.

1. *Anchors.* Of the 51 grams of 50 bytes in each 100-byte window, the one with the smallest hash (leftmost of
   equals) is the window's anchor. The choice depends on the window's content alone, so equal windows have equal
   anchors. Neighbouring windows with one anchor form a *context* (its bytes and where the anchor stands).
   One pass gives (anchor hash, context hash, document, start, windows); copies within a task are settled there.
2. *Contexts.* Dealt out by anchor and read in order: of equal contexts the first stays in question, all windows of
   the others start earlier elsewhere. An anchor with one context is settled.
3. *Pieces.* Contexts in question fetch their bytes. While a group has more than ``WIDE`` of them, its windows are
   halved by their distance from the anchor: the windows of a half all hold more bytes around the anchor, and contexts
   are dealt out anew by these, their cores. Contexts that are equal in a half are settled again, within tasks before
   the exchange too, so a group of near copies shrinks from level to level to those that differ in the half itself.
   A half of one window holds equal strings only, so at most ``log2(LENGTH - GRAM)`` levels, rounded up, are needed.
   *Intervals.* Every group then goes the same way: windows whose hash does not repeat within it are dropped and spans
   that are now equal are merged; on the rest a Burrows-Wheeler transform is built, and breadth-first backward
   extension from the empty string derives the common prefixes of neighbouring suffixes by increasing value and stops
   at 100 (``interval_expansion``): suffixes between two values under 100 start with one and the same string.
4. *Spans.* Removed windows are merged per document and applied to its bytes.

Defined cases: null or short texts lose nothing; ids that are null, repeat, or aren't whole numbers are replaced by
surrogates in the order (id, nulls first; text digest), equal rows being one document; a very long text is anchored
a stretch at a time and held by one task at the end, when its runs are cut; other columns are not passed on,
whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _BYTE_VALUES, U64, Stage, as_long, batch, bounded, chunks, join_few, mix, numbered, powers, table

LENGTH = 100
GRAM = 50
#: Contexts that are compared together by intervals; larger groups are split by their content first.
WIDE = 256
#: Bytes for which one Burrows-Wheeler transform is built.
BLOCK_BYTES = 1 << 20
_START_BITS = 16  # of a packed span: start << 16 | windows
_STRETCH = 1 << 19  # windows whose anchors are found together: a place among them takes 20 bits of a key
_PLACE = U64((1 << 20) - 1)


# ---- anchors --------------------------------------------------------------


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position, by joining grams of powers of two."""
    base, part, width, out, done = int(_BASE), _BYTE_VALUES[raw], 1, None, 0
    while k:
        if k & 1:
            if out is None:
                out = part
            else:
                n = len(part) - done
                out = out[:n] * U64(pow(base, width, 1 << 64)) + part[done : done + n]
            done += width
        k >>= 1
        if k:
            n = len(part) - width
            part = part[:n] * U64(pow(base, width, 1 << 64)) + part[width : width + n]
            width *= 2
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, m = len(x) - width + 1, 1
    while 2 * m <= width:
        x, m = np.minimum(x[:-m], x[m:]), 2 * m
    return np.minimum(x[:n], x[width - m : width - m + n])


def contexts(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, document, start in it, windows) of every run of windows with one anchor."""
    empty = np.zeros(0, np.int64)
    windows = len(raw) - length + 1
    if windows <= 0:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    g = gram_hashes(raw, gram)
    anchor = np.empty(windows, np.int64)
    for at in range(0, windows, _STRETCH):
        own = g[at : at + _STRETCH + length - gram]
        best = sliding_min((own & ~_PLACE) | np.arange(len(own), dtype=np.uint64), length - gram + 1)
        anchor[at : at + len(best)] = (best & _PLACE).astype(np.int64) + at
    sizes = np.diff(off)
    fits = np.zeros(windows + 1, np.int32)  # windows inside one document
    long_ = sizes >= length
    np.add.at(fits, off[:-1][long_], 1)
    np.add.at(fits, off[1:][long_] - length + 1, -1)
    valid = np.cumsum(fits)[:windows] > 0
    begins = valid.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    begins[off[:-1][long_]] = True
    start = np.flatnonzero(begins)
    if not len(start):
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    inside = np.zeros(windows + 1, np.int64)
    np.cumsum(valid, out=inside[1:])
    count = np.diff(np.append(inside[start], inside[-1]))
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up, out=total[1:])
    span = (total[start + count + length - 1] - total[start]) * down[start]
    place = (anchor[start] - start) * 65536 + count
    doc = np.searchsorted(off, start, "right") - 1
    return g[anchor[start]], mix(span ^ mix(place.astype(np.uint64))), doc, start - off[doc], count


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, ctx, doc, span); of copies within a task's stretch of text the later ones come with ctx null, as settled."""
    for rows in batches:
        ids = rows.column(0).to_numpy()
        found = []
        for lo, hi, raw, off in chunks(rows.column(1)):
            h, ctx, doc, start, count = contexts(raw, off, length, gram)
            found.append((h, ctx, ids[lo:hi][doc], start << _START_BITS | count))
        if not found:
            continue
        h, ctx, doc, span = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((span, doc, ctx, h))
        h, ctx, doc, span = h[order], ctx[order], doc[order], span[order]
        once = _groups(h, ctx, doc, span)  # equal rows of the table are one document
        h, ctx, doc, span = h[once], ctx[once], doc[once], span[once]
        first = _groups(h, ctx)
        settled = np.flatnonzero(~first)
        h[settled] = mix(doc[settled].astype(np.uint64) * U64(31) + span[settled].astype(np.uint64))  # anywhere: only spread
        yield batch(h=pa.array(as_long(h)), ctx=pa.array(as_long(ctx), mask=~first), doc=pa.array(doc), span=pa.array(span))


def _settled(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, ctx, doc, span) in this order to rows (doc, span, h, contexts); h is null where the span's windows go.

    Only the first contexts of the anchor at hand are held, up to ``wide``; with more it is known to be wide.
    """

    def made(doc, span, h=None, kinds=None):
        n = len(doc)
        return batch(doc=pa.array(doc), span=pa.array(span), h=pa.nulls(n, pa.int64()) if h is None else pa.array(h), contexts=pa.nulls(n, pa.int32()) if h is None else pa.array(np.minimum(kinds, wide + 1).astype(np.int32)))

    last = known = None
    held = [np.zeros(0, np.int64)] * 3
    for rows in batches:
        gone = rows.column(1).is_null().to_numpy(zero_copy_only=False)
        h, ctx, doc, span = (c.to_numpy()[~gone] if k != 1 else c.fill_null(0).to_numpy()[~gone] for k, c in enumerate(rows.columns))
        if gone.any():
            yield made(rows.column(2).to_numpy()[gone], rows.column(3).to_numpy()[gone])
        if not len(h):
            continue
        once, first = _groups(h, ctx, doc, span), _groups(h, ctx)  # equal rows of the table are one document
        if last is not None:
            once[0], first[0] = (h[0], ctx[0], doc[0], span[0]) != last, (h[0], ctx[0]) != last[:2]
        last = (h[-1], ctx[-1], doc[-1], span[-1])
        later = once & ~first
        yield made(doc[later], span[later])
        h, doc, span = (np.concatenate((x, y[first])) for x, y in zip(held, (h, doc, span), strict=True))
        if not len(h):
            continue
        begin = np.flatnonzero(_groups(h))
        sizes = np.diff(np.append(begin, len(h)))
        if known is not None and h[0] == known:
            sizes[0] = wide + 1
            kinds = np.repeat(sizes, np.diff(np.append(begin, len(h))))
        else:
            kinds = np.repeat(sizes, sizes)
        known, end = (h[-1], len(h)) if kinds[-1] > wide else (None, begin[-1])
        ask = np.flatnonzero(kinds[:end] > 1)
        yield made(doc[ask], span[ask], h[ask], kinds[ask])
        held = [x[end:] for x in (h, doc, span)]
    if len(held[0]) > 1:
        yield made(held[1], held[2], held[0], np.full(len(held[0]), len(held[0])))


def _span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


_HALVED = "h long, ctx long, doc long, span long, bytes binary, anchor int, low int, high int"


def _halved(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts (h, doc, span, bytes, anchor, low, high) to their windows that start ``low`` to the middle, and those that start farther before the anchor.

    The new h is a hash of the bytes that all windows of the half hold, and the old h; ctx is null where an equal context of
    this task is earlier. An ``anchor`` of -1 is found first: in the range that all windows cover, leftmost.
    """
    for whole in batches:
        for part in range(0, whole.num_rows, 4000):
            rows = whole.slice(part, 4000)
            h, doc, span, anchor, low, high = (rows.column(k).to_numpy() for k in (0, 1, 2, 4, 5, 6))
            anchor = anchor.astype(np.int64)
            data = rows.column(3)
            sizes = pc.binary_length(data).to_numpy().astype(np.int64)
            raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
            base = np.cumsum(sizes) - sizes
            count, start = span & 0xFFFF, span >> _START_BITS
            if (anchor < 0).any():
                spots = length - gram + 2 - count
                owner, at = np.repeat(np.arange(len(h)), spots), _ranges(count - 1, spots)
                same = np.flatnonzero(as_long(gram_hashes(raw, gram))[base[owner] + at] == h[owner])
                hit = same[::-1]
                found = np.full(len(h), -1, np.int64)
                found[owner[hit]] = at[hit]  # the leftmost is written last
                anchor = np.where(anchor < 0, found, anchor)
            middle = (low.astype(np.int64) + high) // 2
            out = []
            for upper in (False, True):
                skip = np.zeros_like(count) if upper else np.maximum(0, anchor - middle)
                many = np.minimum(count, anchor - middle) if upper else count - skip
                lo, hi = (middle + 1, high.astype(np.int64)) if upper else (low.astype(np.int64), middle)
                k = np.flatnonzero((many > 0) & (lo <= hi))
                lo, hi, skip, many, spot = lo[k], hi[k], skip[k], many[k], anchor[k] - skip[k]
                begin = base[k] + skip
                core = _span_hashes(raw, begin + spot - lo, begin + spot + length - hi)
                key = mix(core ^ mix(h[k].view(np.uint64) + (lo << 16 | hi).astype(np.uint64)))
                ctx = mix(_span_hashes(raw, begin, begin + many + length - 1) + (spot << 16 | many).astype(np.uint64))
                out.append((as_long(key), as_long(ctx), doc[k], start[k] + skip << _START_BITS | many, begin, many, spot, lo, hi))
            h, ctx, doc, span, begin, many, spot, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
            by = np.lexsort((span, doc, ctx, h))
            h, ctx, doc, span, begin, many, spot, lo, hi = (x[by] for x in (h, ctx, doc, span, begin, many, spot, lo, hi))
            later = ~_groups(h, ctx)
            h = np.where(later, as_long(mix(doc.astype(np.uint64) * U64(31) + span.astype(np.uint64))), h)  # anywhere: only spread
            pieces = [None if gone else raw[b : b + m + length - 1].tobytes() for gone, b, m in zip(later, begin, many, strict=True)]
            small = lambda x: pa.array(x.astype(np.int32))
            yield batch(h=pa.array(h), ctx=pa.array(ctx, mask=later), doc=pa.array(doc), span=pa.array(span), bytes=pa.array(pieces, pa.binary()), anchor=small(spot), low=small(lo), high=small(hi))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_halved`` in the order (h, ctx, doc, span): the first of equal contexts; of the others doc and span, h being null."""
    last = None
    for rows in batches:
        if not rows.num_rows:
            continue
        gone = rows.column(1).is_null().to_numpy(zero_copy_only=False)
        h, ctx = rows.column(0).to_numpy(), rows.column(1).fill_null(0).to_numpy()
        first = _groups(h, ctx) | np.append(True, gone[:-1])
        if last is not None:
            first[0] = (h[0], ctx[0]) != last
        last = None if gone[-1] else (h[-1], ctx[-1])
        first &= ~gone
        yield batch(h=pa.array(h, mask=~first), **{c: rows.column(c) for c in rows.schema.names[2:]})


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each pair."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


# ---- intervals ------------------------------------------------------------


def rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the rotations of ``text`` in the order of their first ``depth`` bytes."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << U64(8) | np.roll(text, -k).astype(np.uint64)
    known = 8
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(_groups(key[order])) - 1
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        key = (rank * n + np.roll(rank, -known)).astype(np.uint64)
        known *= 2


def interval_expansion(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotations in order, group of each): rotations of one group, and only they, share their first ``length`` bytes.

    ``short[i]`` is set once the i-th rotation is known to share fewer than ``length`` bytes with the one before it.
    The queue of a level holds the intervals of the strings of that many bytes that set a value; extending a string
    by the byte before it maps its interval through the transform. A string whose right end already has a value
    derives nothing new, and neither do its extensions.
    """
    n = len(text)
    order = rotations(text, length)
    before = np.roll(text, 1)[order].astype(np.int64)  # the Burrows-Wheeler transform
    mapped = np.empty(n, np.int64)
    mapped[np.argsort(before, kind="stable")] = np.arange(n)
    short = np.zeros(n + 1, bool)
    short[[0, n]] = True
    lows, highs = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(length):
        if not len(lows):
            break
        sizes = highs - lows
        one = sizes == 1
        wide_lows, wide_sizes = lows[~one], sizes[~one]
        if len(wide_lows):
            owner = np.repeat(np.arange(len(wide_lows)), wide_sizes)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(wide_sizes) - wide_sizes, wide_sizes) + wide_lows[owner]
            key = owner * 256 + before[at]
            by = np.argsort(key, kind="stable")
            new = np.flatnonzero(_groups(key[by]))
            last = np.append(new[1:], len(by)) - 1
            lows, highs = np.concatenate((mapped[at[by[new]]], mapped[lows[one]])), np.concatenate((mapped[at[by[last]]] + 1, mapped[lows[one]] + 1))
        else:
            lows = mapped[lows]
            highs = lows + 1
        fresh = ~short[highs]
        lows, highs = lows[fresh], highs[fresh]
        short[highs] = True
    return order, np.cumsum(short[:n]) - 1


def _repeats(h, doc, start, count, spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, span) of the windows that also start earlier, among contexts with their bytes."""
    sizes = count + length - 1
    raw = np.frombuffer(b"".join(spans), np.uint8)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(h)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    where = base[owner] + at
    window = gram_hashes(raw, length)[where] ^ mix(h.view(np.uint64))[owner]
    by = np.argsort(window)
    new = _groups(window[by])
    often = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
    again = np.zeros(len(owner), bool)
    again[by[often]] = True
    owner, at, where = owner[again], at[again], where[again]
    if not len(owner):
        return owner, owner
    run = np.ones(len(owner), bool)  # maximal runs of windows that repeat
    run[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(run)
    many = np.diff(np.append(begin, len(owner)))
    pieces = [raw[where[b] : where[b] + m + length - 1].tobytes() for b, m in zip(begin, many, strict=True)]
    anchor, doc_of, from_ = h[owner[begin]], doc[owner[begin]], start[owner[begin]] + at[begin]
    first: dict[tuple[int, bytes], int] = {}
    kept, later = [], []
    for k in np.lexsort((from_, doc_of)).tolist():  # earliest first: equal spans of an anchor count once
        (kept if first.setdefault((int(anchor[k]), pieces[k]), k) == k else later).append(k)
    out_doc, out_at = [np.repeat(doc_of[later], many[later])], [_ranges(from_[later], many[later])]
    kept = np.array(kept, np.int64)
    kept = kept[np.argsort(anchor[kept], kind="stable")]
    lo = 0
    while lo < len(kept):
        hi, total = lo, 0
        while hi < len(kept) and (total < BLOCK_BYTES or anchor[kept[hi]] == anchor[kept[hi - 1]]):
            total += len(pieces[kept[hi]]) + 1
            hi += 1
        block = kept[lo:hi]
        lo = hi
        text = np.frombuffer(b"\xff" + b"\xff".join(pieces[k] for k in block) + b"\xff", np.uint8)  # 0xff is in no UTF-8 text
        sizes = many[block] + length
        spot = _ranges(np.cumsum(sizes) - sizes + 1, many[block])
        order, group = interval_expansion(text, length)
        by_place = np.empty(len(text), np.int64)
        by_place[order] = group
        cluster = by_place[spot]
        d, s = np.repeat(doc_of[block], many[block]), _ranges(from_[block], many[block])
        by = np.lexsort((s, d, cluster))
        rest = by[~_groups(cluster[by])]
        out_doc.append(d[rest])
        out_at.append(s[rest])
    d, s = np.concatenate(out_doc), np.concatenate(out_at)
    by = np.lexsort((s, d))
    d, s = d[by], s[by]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    new[:: 60_000] = True  # a packed span holds fewer than 65,536 windows
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(d)) - 1
    return d[head], s[head] << _START_BITS | (s[tail] - s[head] + 1)


def _compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts (h, doc, span, bytes) in the order of h to rows (doc, span) of windows that go; whole groups, about 16 blocks of bytes at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def compare(rows: pa.Table) -> pa.RecordBatch:
        h, doc, span = (rows.column(k).to_numpy() for k in range(3))
        d, s = _repeats(h, doc, span >> _START_BITS, span & 0xFFFF, rows.column(3).to_pylist(), length)
        return batch(doc=pa.array(d), span=pa.array(s))

    for rows in batches:
        if not rows.num_rows:
            continue
        held.append(rows)
        size += rows.num_rows * (length + 30)
        if size >= 16 * BLOCK_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield compare(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = (table.num_rows - cut) * (length + 30)
    if held:
        yield compare(pa.Table.from_batches(held).combine_chunks())


def _bytes_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Documents (doc, text, asked: array of (h, span, contexts)) to rows (h, doc, span, bytes, contexts)."""
    for rows in batches:
        for part in range(0, rows.num_rows, 500):
            out: list[list] = [[] for _ in range(5)]
            for doc, text, asked in zip(*(c.to_pylist() for c in rows.slice(part, 500).columns), strict=True):
                data = (text or "").encode()
                for x in asked:
                    begin = x["span"] >> _START_BITS
                    for column, value in zip(out, (x["h"], doc, x["span"], data[begin : begin + (x["span"] & 0xFFFF) + length - 1], x["contexts"]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "doc", "span", "bytes", "contexts"])


# ---- spans ----------------------------------------------------------------


def _merged(spans: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Packed windows to maximal runs of bytes (begin, end)."""
    if not spans:
        return []
    x = np.sort(np.array(spans, np.int64))
    begin, end = x >> _START_BITS, (x >> _START_BITS) + (x & 0xFFFF) + length - 1
    reach = np.maximum.accumulate(end)
    new = np.ones(len(x), bool)
    new[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(begin[first].tolist(), reach[np.append(first[1:], len(x)) - 1].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "removed", "kept_sha256"] + ["kept"] * with_text
    kinds = (pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary())
    for rows in batches:
        for part in range(0, rows.num_rows, 500):
            some = rows.slice(part, 500)
            out: list[list] = [[] for _ in names[1:]]
            for text, spans in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                runs, kept, at = _merged(spans, length), [], 0
                for begin, end in runs:
                    kept.append(data[at:begin])
                    at = end
                rest = b"".join([*kept, data[at:]])
                for column, value in zip(out, (len(data), [{"begin": b, "end": e} for b, e in runs], hashlib.sha256(rest).hexdigest(), rest), strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, wide: int = WIDE, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (array of byte runs), kept_sha256 [, kept (binary)]."""
    spark = docs.sparkSession
    stage = Stage(spark, "substrings")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = numbered(docs, "doc_id", "text", stage).select(F.col("_doc").alias("doc"), "_row.doc_id", "_row.text")

    body = docs.filter(F.octet_length("text") >= length).select("doc", "text")
    anchored = body.mapInArrow(lambda it: _anchored(it, length, gram), "h long, ctx long, doc long, span long")
    dealt = anchored.repartition("h").sortWithinPartitions("h", "ctx", "doc", "span")
    settled = stage.write(dealt.mapInArrow(lambda it: _settled(it, wide), "doc long, span long, h long, contexts int"), "settled")

    asked = settled.filter("h is not null").groupBy("doc").agg(F.collect_list(F.struct("h", "span", "contexts")).alias("asked"))
    asked = stage.write(asked, "asked")
    with_bytes = join_few(body, asked, "doc").select("doc", "text", "asked").mapInArrow(lambda it: _bytes_of(it, length), "h long, doc long, span long, bytes binary, contexts int")
    with_bytes = stage.write(with_bytes, "bytes")
    stage.drop("asked")

    def compared(contexts: DataFrame) -> DataFrame:
        rows = contexts.select("h", "doc", "span", "bytes").repartition("h").sortWithinPartitions("h")
        return rows.mapInArrow(lambda it: _compared(it, length), "doc long, span long")

    spans = settled.filter("h is null").select("doc", "span").unionByName(compared(with_bytes.filter(F.col("contexts") <= wide)))
    large = with_bytes.filter(F.col("contexts") > wide).select("h", "doc", "span", "bytes", F.lit(-1).alias("anchor"), F.lit(0).alias("low"), F.lit(length - gram).alias("high"))
    levels = 0
    while large.limit(1).count():
        levels += 1
        halves = large.mapInArrow(lambda it: _halved(it, length, gram), _HALVED).repartition("h", "ctx").sortWithinPartitions("h", "ctx", "doc", "span")
        once = stage.write(halves.mapInArrow(_once, _HALVED.replace("ctx long, ", "")), f"level-{levels}")
        open_ = once.filter("h is not null")
        crowded = stage.write(open_.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > wide).select("h"), f"crowded-{levels}")
        spans = spans.unionByName(once.filter("h is null").select("doc", "span")).unionByName(compared(open_.join(bounded(crowded), "h", "left_anti")))
        large = open_.join(bounded(crowded), "h", "left_semi")
    spans = stage.write(spans.groupBy("doc").agg(F.collect_list("span").alias("spans")), "spans")
    stage.drop("settled", "bytes", *(f"{name}-{k + 1}" for k in range(levels) for name in ("level", "crowded")))

    schema = f"doc_id {kind}, n_bytes long, removed array<struct<begin: long, end: long>>, kept_sha256 string" + ", kept binary" * with_text
    touched = join_few(docs, spans, "doc").select("doc_id", "text", "spans").mapInArrow(lambda it: _cut(it, length, with_text), schema)
    rest = docs.join(bounded(spans.select("doc")), "doc", "left_anti")
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    none = F.array().cast("array<struct<begin: long, end: long>>")
    columns = [F.col("doc_id"), F.length(data).cast("long").alias("n_bytes"), none.alias("removed"), F.sha2(data, 256).alias("kept_sha256"), data.alias("kept")]
    return touched.unionByName(rest.select(columns[: 4 + with_text]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


SQL = f"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, (length(hex(encode(coalesce(text, '')))) // 2)::BIGINT AS n FROM documents
), strings AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 2 * {LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(n - {LENGTH} + 1)) AS p FROM bytes WHERE n >= {LENGTH})
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM strings) WHERE k > 1
), heads AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS head FROM again
), runs AS (
  SELECT doc_id, run, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM heads) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS before, lead(a) OVER w AS after FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), cut AS (
  SELECT g.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * before + 1, (2 * (a - before))::BIGINT), '' ORDER BY a) || max(CASE WHEN after IS NULL THEN substr(h, 2 * b + 1) ELSE '' END) AS kept
  FROM gaps g JOIN bytes ON g.doc_id = bytes.doc_id GROUP BY g.doc_id
)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM bytes b LEFT JOIN cut ON b.doc_id = cut.doc_id
"""
