"""Cross-tokenizer alignment: which tokens of one vocabulary end where those of another end, and which go together most.

Each text is encoded twice, by a byte-level vocabulary (A) and a piece vocabulary (B), over the same bytes. Where tokens of
both end, they are linked, and the text is cut into a group of A tokens and a group of B tokens over the same bytes. Corpus
counts say how often a pair of ids is linked; the best A ids of a B id are those with its highest count.

1. One pass over the texts encodes them. What is kept of a document is small: its numbers, a digest of its groups, and
   its links as pairs of ids. Documents get a number within a *batch* of at most ``BATCH_LINKS`` links.
2. Counting: each task adds up its pairs first, so that a pair that a third of all links are is one row a task. Sums are
   partitioned by *stripe*, ``STRIPE`` B ids that stand together, and added (``np.add.at``) to the stripe's dense matrix
   of B ids times all A ids (26 MB for 64 x 50,257), one matrix at a time. The matrix's row maxima are the best counts.
3. Scoring: links meet their stripe's matrix. A stripe of frequent ids is dealt to as many parts as its number of links
   asks for, each with its own copy of the matrix, stripes of rare ids share a part; so no part holds more than about ``PART_LINKS`` links whatever
   the corpus and however skewed its ids are. Within a part a stripe's matrix comes first and its links stream past it; sums by
   batch and document come out, and are added up batch by batch.

The driver only sees one number for each stripe, which is bounded by the vocabulary.

Both vocabularies have only entries of at least one byte, so at a place where both end there is one link.

Defined cases: null and empty texts, and those whose tokens' joined bytes aren't the text's (a vocabulary that rewrites
some character), have no tokens: zeros and ''; strings of special tokens are plain text; ids may be null, repeat or be
of any type, and rows that repeat count each; ties of the highest count are all best; a text of any length is encoded
whole; an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, batch, slices, table
from .packing import public_spec, tokenizer

#: B ids of a matrix.
STRIPE = 64
BATCH_LINKS = 1 << 18
BATCH_DOCS = 1 << 16
#: Links of a part: no more than the first if there are enough parts for each stripe, never more than the second.
PART_LEAST, PART_LINKS = 20_000, 4_000_000
#: Distinct pairs that a task adds up before it passes them on.
TASK_PAIRS = 2_000_000
CHUNK_BYTES = 1 << 20


def public_vocabularies() -> tuple[tuple, str]:
    import public_tokenizers as public

    return (*public_spec(), True), public.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both vocabularies, with the bytes of each entry."""

    def __init__(self, spec_a: tuple, path_b: str):
        import sentencepiece

        self.coder = tokenizer(*spec_a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, vocabulary = _byte_alphabet(), self.coder.whole.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes_a[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        n = self.pieces.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(self.pieces.id_to_piece, range(n)))]
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        marks = ",|;"
        self.said = [f"{k}{m}" for k in range(max(len(self.bytes_a), n)) for m in marks]

    def align(self, text: str, b: list[int]) -> tuple[int, int, str, np.ndarray] | None:
        """Tokens of A and B, the groups spelled out, and the links as (B id) * (size of A) + (A id); None if bytes differ."""
        raw, a = f" {text}".encode(), self.coder.ids(f" {text}")
        if b"".join([self.bytes_a[k] for k in a]) != raw or b"".join([self.bytes_b[k] for k in b]) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
        ends = np.zeros(len(raw) + 1, np.uint8)
        ends[end_a] = 1
        ends[end_b] |= 2
        last_a, last_b = ends[end_a] == 3, ends[end_b] == 3
        first_a, first_b = (np.concatenate([[0], np.flatnonzero(x) + 1]) for x in (last_a, last_b))
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + first_b[group_a]] = 3 * a + last_a
        order[np.arange(len(b)) + first_a[group_b + 1]] = 3 * b + 2 * last_b
        groups = "".join([self.said[k] for k in order.tolist()])[:-1]
        return len(a), len(b), groups, b[last_b] * len(self.bytes_a) + a[last_a]


_loaded: dict[tuple, Aligner] = {}


def aligner(*spec) -> Aligner:
    if spec not in _loaded:
        _loaded[spec] = Aligner(*spec)
    return _loaded[spec]


# ---- documents ------------------------------------------------------------


def _aligned(batches: Iterator[pa.RecordBatch], spec: tuple) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, id) to (batch, place, id, n_a, n_b, n_links, groups, links)."""
    both = aligner(*spec)
    first, place, filled = None, 0, 0
    for rows in batches:
        for part in slices(rows, 1, CHUNK_BYTES):
            out: list[list] = [[] for _ in range(7)]
            numbers, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            for row, text, b in zip(numbers, texts, both.pieces.encode(texts, num_threads=1), strict=True):
                if first is None or filled >= BATCH_LINKS or place >= BATCH_DOCS:
                    first, place, filled = row, 0, 0
                found = both.align(text, b) if text else None
                n_a, n_b, groups, links = found or (0, 0, "", np.zeros(0, np.int64))
                digest = hashlib.sha256(groups.encode()).hexdigest() if found else ""
                for column, value in zip(out, (first, place, n_a, n_b, len(links), digest, links.astype("<u8" if len(both.bytes_a) * len(both.bytes_b) >> 32 else "<u4").tobytes()), strict=True):
                    column.append(value)
                place, filled = place + 1, filled + len(links)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            made = [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made[:2], part.column(2), *made[2:]], names=["batch", "place", "id", "n_a", "n_b", "n_links", "groups_sha256", "links"])


# ---- counts ---------------------------------------------------------------


def _links(column: pa.Array, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column)]).astype(np.int64)


def _by_stripe(keys: np.ndarray, counts: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Sorted pairs and their counts, a row for each stripe of ``width`` pairs."""
    stripes, begin = np.unique(keys // width, return_index=True)
    ends = [*begin[1:], len(keys)]
    if len(stripes):
        pairs = [(keys[a:b] - s * width).astype("<u4").tobytes() for s, a, b in zip(stripes, begin, ends, strict=True)]
        sums = [counts[a:b].astype("<i8").tobytes() for a, b in zip(begin, ends, strict=True)]
        yield batch(stripe=pa.array(stripes, pa.int32()), pairs=pa.array(pairs, pa.binary()), sums=pa.array(sums, pa.binary()))


def _tallied(batches: Iterator[pa.RecordBatch], kind: str, width: int) -> Iterator[pa.RecordBatch]:
    """The task's own sums."""
    keys = counts = np.zeros(0, np.int64)
    for rows in batches:
        found, times = np.unique(_links(rows.column(0), kind), return_counts=True)
        keys, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
        more = np.zeros(len(keys), np.int64)
        np.add.at(more, at, np.concatenate([counts, times]))
        counts = more
        if len(keys) > TASK_PAIRS:
            yield from _by_stripe(keys, counts, width)
            keys = counts = np.zeros(0, np.int64)
    yield from _by_stripe(keys, counts, width)


def _counted(batches: Iterator[pa.RecordBatch], size_a: int, stripe: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by stripe to one row a stripe: its pairs, their counts, the highest count of each B id."""
    now, block = None, np.zeros((stripe, size_a), np.int64)

    def done() -> pa.RecordBatch:
        pairs = np.flatnonzero(block)
        sums = block.ravel()[pairs]
        return batch(stripe=pa.array([now], pa.int32()), load=pa.array([int(sums.sum())]), pairs=pa.array([pairs.astype("<u4").tobytes()], pa.binary()), sums=pa.array([sums.astype("<i8").tobytes()], pa.binary()), best=pa.array([block.max(1).astype("<i8").tobytes()], pa.binary()))

    for rows in batches:
        for s, pairs, sums in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2), strict=True):
            if s != now:
                if now is not None:
                    yield done()
                now = s
                block[:] = 0
            np.add.at(block.ravel(), np.frombuffer(pairs.as_buffer(), "<u4").astype(np.int64), np.frombuffer(sums.as_buffer(), "<i8"))
    if now is not None:
        yield done()


# ---- scores ---------------------------------------------------------------

_PART = "part int, kind int, batch long, places binary, pairs binary, sums binary"


def _parts(loads: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first part and the number of parts of each stripe, and the number of all: heavy stripes are split, light ones share a part."""
    first, parts = np.zeros(len(loads), np.int64), np.ones(len(loads), np.int64)
    now = filled = 0
    for s, load in enumerate(loads.tolist()):
        if filled and filled + load > most:
            now, filled = now + 1, 0
        first[s] = now
        if load > most:
            parts[s] = -(-load // most)
            now += int(parts[s])
        else:
            filled += load
    return first, parts, now + (filled > 0 or now == 0)


def _dealt(batches: Iterator[pa.RecordBatch], kind: str, width: int, first: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (batch, place, links) to the pairs of each batch, by part: places, pairs and how often each place has the pair."""
    step = max(1, PART_LEAST // 2)
    for rows in batches:
        of, places = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64)
        edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), rows.num_rows]
        out: list[list] = [[] for _ in range(6)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            blobs = [np.frombuffer(x.as_buffer(), kind) for x in rows.column(2)[lo:hi]]
            keys = np.concatenate([np.zeros(0, kind), *blobs]).astype(np.int64)
            where = np.repeat(places[lo:hi], [len(x) for x in blobs])
            stripes, local = np.divmod(keys, width)
            # in the order of the stripe, then the place; a number of 64 bits holds both and the pair
            mixed, times = np.unique((stripes * BATCH_DOCS + where) * width + local, return_counts=True)
            mixed, local = np.divmod(mixed, width)
            stripes, where = np.divmod(mixed, BATCH_DOCS)
            found, begin = np.unique(stripes, return_index=True)
            for s, a, b in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(stripes)], strict=True):
                for k, at in enumerate(range(a, b, step)):
                    end = min(at + step, b)
                    part = int(first[s]) + (int(of[lo]) * 0x9E3779B1 + int(places[lo]) * 7919 + k) % int(parts[s])
                    values = (part, 2 * s + 1, int(of[lo]), *(x[at:end].astype("<u4").tobytes() for x in (where, local, times)))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
        if out[0]:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["part", "kind", "batch", "places", "pairs", "sums"])


def _scored(batches: Iterator[pa.RecordBatch], size_a: int, stripe: int) -> Iterator[pa.RecordBatch]:
    """Rows of parts, each stripe's matrix (of even kind) before its links, to sums (batch, places, best, counts)."""
    block, best = np.zeros(stripe * size_a, np.int64), np.zeros(stripe, np.int64)
    for rows in batches:
        out: list[list] = [[] for _ in range(4)]
        for kind, of, *blobs in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3), rows.column(4), rows.column(5), strict=True):
            places, pairs, sums = (b.as_buffer() for b in blobs)
            pairs = np.frombuffer(pairs, "<u4").astype(np.int64)
            if kind % 2 == 0:
                block[:] = 0
                block[pairs], best = np.frombuffer(sums, "<i8"), np.frombuffer(places, "<i8")
                continue
            places, times = np.frombuffer(places, "<u4"), np.frombuffer(sums, "<u4").astype(np.int64)
            counts = block[pairs]
            begin = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            highest = np.add.reduceat(np.where(counts == best[pairs // size_a], times, 0), begin)
            for column, value in zip(out, (of, places[begin].tobytes(), highest.astype("<i8").tobytes(), np.add.reduceat(counts * times, begin).astype("<i8").tobytes()), strict=True):
                column.append(value)
        if out[0]:
            yield batch(batch=pa.array(out[0], pa.int64()), places=pa.array(out[1], pa.binary()), highest=pa.array(out[2], pa.binary()), counts=pa.array(out[3], pa.binary()))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums sorted by batch to (batch, place, n_best, count_sum)."""
    now, sums = None, np.zeros((BATCH_DOCS, 2), np.int64)

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(sums[:, 1])
        return batch(batch=pa.array(np.full(len(at), now, np.int64)), place=pa.array(at, pa.int32()), n_best=pa.array(sums[at, 0]), count_sum=pa.array(sums[at, 1]))

    for rows in batches:
        for of, places, highest, counts in zip(rows.column(0).to_pylist(), *rows.columns[1:], strict=True):
            if of != now:
                if now is not None:
                    yield done()
                now = of
                sums[:] = 0
            at = np.frombuffer(places.as_buffer(), "<u4")
            np.add.at(sums, at, np.stack([np.frombuffer(x.as_buffer(), "<i8") for x in (highest, counts)], 1))
    if now is not None:
        yield done()


# ---- the operator ---------------------------------------------------------


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: tuple | None = None, stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row; and b_id, a_id, count, is_best of each pair of ids that is linked anywhere.

    ``spec`` is (arguments of ``packing.tokenizer`` for A, model file of B).
    """
    spark, spec = docs.sparkSession, spec or public_vocabularies()
    stage = stage or Stage(spark, "align")
    both = aligner(*spec)
    size_a, size_b = len(both.bytes_a), len(both.bytes_b)
    width, stripes, kind = STRIPE * size_a, -(-size_b // STRIPE), "<u8" if size_a * size_b >> 32 else "<u4"
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id"))
    shape = f"batch long, place int, id {id_type}, n_a long, n_b long, n_links long, groups_sha256 string, links binary"
    kept = stage.write(rows.mapInArrow(lambda it: _aligned(it, spec), shape), "documents")

    sums = kept.select("links").mapInArrow(lambda it: _tallied(it, kind, width), "stripe int, pairs binary, sums binary")
    sums = sums.repartition("stripe").sortWithinPartitions("stripe")
    counts = stage.write(sums.mapInArrow(lambda it: _counted(it, size_a, STRIPE), "stripe int, load long, pairs binary, sums binary, best binary"), "counts")

    loads = np.zeros(stripes, np.int64)
    for r in counts.select("stripe", "load").collect():
        loads[r.stripe] = r.load
    most = min(PART_LINKS, max(PART_LEAST, -(-int(loads.sum()) // (2 * stripes))))
    first, parts, n_parts = _parts(loads, most)
    deal = spark.createDataFrame([(k, int(first[k]), int(parts[k])) for k in range(stripes)], "stripe int, first int, parts int")
    copies = counts.join(F.broadcast(deal), "stripe").select(F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("part"), (2 * F.col("stripe")).alias("kind"), F.lit(None).cast("long").alias("batch"), F.col("best").alias("places"), "pairs", "sums")
    links = kept.filter("n_links > 0").select("batch", "place", "links").mapInArrow(lambda it: _dealt(it, kind, width, first, parts), _PART)
    dealt = copies.unionByName(links).repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "kind")
    scored = dealt.mapInArrow(lambda it: _scored(it, size_a, STRIPE), "batch long, places binary, highest binary, counts binary")
    scored = scored.repartition("batch").sortWithinPartitions("batch").mapInArrow(_summed, "batch long, place int, n_best long, count_sum long")

    joined = kept.drop("links").join(scored, ["batch", "place"], "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = joined.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", none("n_best"), none("count_sum"), "groups_sha256")
    return out, counts.mapInArrow(lambda it: _pairs(it, size_a, STRIPE), "b_id int, a_id int, count long, is_best boolean")


def _pairs(batches: Iterator[pa.RecordBatch], size_a: int, stripe: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for s, pairs, sums, best in zip(rows.column(0).to_pylist(), *rows.columns[2:], strict=True):
            pairs, sums = np.frombuffer(pairs.as_buffer(), "<u4").astype(np.int64), np.frombuffer(sums.as_buffer(), "<i8")
            b = pairs // size_a
            yield batch(b_id=pa.array(s * stripe + b, pa.int32()), a_id=pa.array(pairs % size_a, pa.int32()), count=pa.array(sums), is_best=pa.array(sums == np.frombuffer(best.as_buffer(), "<i8")[b]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]
