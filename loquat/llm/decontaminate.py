"""Benchmark decontamination: latent semantic retrieval, then word-order and answer checks.

1. One pass counts, over the passages of all documents, in how many each word occurs (2**20 hashed counters). What a
   document has from an item (three of four words in a row, looked up in a Bloom filter of the benchmark's) isn't
   counted, so an item that many documents leak keeps the weight of its words.
2. The words of the whole benchmark span the TF-IDF space. A randomised SVD of the TF-IDF passages of all documents (equal
   texts count once) and of every benchmark item is computed by the executors: rounds over the items alone give a
   basis near theirs, then one pass over everything multiplies all passages by it and back, from which the singular
   vectors follow (Nystroem's method). Only words x basis sums come to the driver, bounded by the hashed vocabulary.
3. One more pass projects every passage of every document (32 and 64 words long, every 16 words) into the
   latent space. Items of over ``PASSAGE`` words are cut into pieces of at most that many. An item is a candidate of
   a passage if the cosine to one of its pieces is at least ``COSINE`` and the passage holds at least ``SHARE`` of the
   piece along the piece's direction; the whole item is then looked for around the passage.
4. A candidate is a leak if the longest common subsequence of the item's words and a stretch of at most ``LOOSENESS``
   times as many words of the document, around the passage, has ``LCS`` of the item's words; or, for a paraphrase,
   ``LOOSE`` of them, and the item's answer (its last sentence of at least ``ANSWER_WORDS`` words, else its last words)
   is found there by the same rule. What is searched for an item depends on its own length alone.

Each document is searched within one task, so no passage is shuffled. One vocabulary and one basis serve the whole
benchmark; its items are only searched for in blocks of ``ITEMS``, which bounds what a task holds and changes no result.

Case never counts. Defined cases: null and empty texts leak nothing; items without words, or null, match nothing; items that
repeat are each reported; rows that repeat are each judged; rows without id are judged like others and reported with a
null id; ids are of any type; an empty table or benchmark gives no row; items of fewer than ``LEAST`` words match only as
a whole; a very long text is held by one task, but compared with the items some thousand passages at a time; columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Stage, add_blocks, batch, bounded, byte_classes, chunks, mix, pack_blocks, table, word_hashes

WORD_BITS = 20
BLOCKS = 64
UNIT, SPANS = 16, (2, 4)  # words; units of a passage
PASSAGE = 64
RANK, EXTRA, ROUNDS = 96, 24, 2
ENTRIES = 1 << 13  # words of passages multiplied at a time
ITEMS = 20_000  # searched for in one pass
PASSAGES = 2_048  # compared with the items at a time
COSINE, SHARE = 0.3, 0.5
LCS, LOOSE = 0.8, 0.6
LOOSENESS = 2  # words of a document in which an item is looked for, in the item's words
ANSWER_WORDS = 5
LEAST = 8
GRAMS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))  # the words of four that stay if one is replaced
BITS_MAX = 28  # of the Bloom filter, two a gram; 64 bits for each gram, up to 32 MB: beyond about 1.4 million words of benchmark more words are taken for copied
_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, first = word_hashes(raw, off, *byte_classes(_MARKS, lower=True))
    return h, first


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & U64((1 << WORD_BITS) - 1)).astype(np.int64)


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _words(raw, np.array([0, len(raw)]))[0]


def _passage_ids(first: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """A number for the ``size``-word passage of each word, and how many there are."""
    words = np.diff(first)
    parts = -(-words // size)
    base = np.cumsum(parts) - parts
    inside = np.arange(first[-1]) - np.repeat(first[:-1], words)
    return np.repeat(base, words) + inside // size, int(parts.sum())


def _grams(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray]]:
    """(places, first word, hash) of each kind of gram within the documents."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for kind, (i, j, k) in enumerate(GRAMS):
        n = len(h) - k
        if n <= 0:
            continue
        at = np.flatnonzero(doc[:n] == doc[k:])
        yield (i, j, k), at, mix(mix(mix(h[at] + U64(kind)) + h[at + j]) + h[at + k])


def _bits(gram: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (gram & U64(size - 1)).astype(np.int64), (gram >> U64(64 - size.bit_length() + 1)).astype(np.int64)


class Copied:
    """Which words of a text stand in a gram of the benchmark."""

    def __init__(self, words: int):
        self.size = 1 << min(BITS_MAX, max(16, (64 * len(GRAMS) * words).bit_length()))
        self.bits = np.zeros(self.size // 8, np.uint8)

    def add(self, items: list[np.ndarray]) -> None:
        first = np.cumsum([0, *map(len, items)])
        for _, _, gram in _grams(np.concatenate([np.zeros(0, np.uint64), *items]), first):
            for at in _bits(gram, self.size):
                np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def words(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for places, at, gram in _grams(h, first):
            a, b = _bits(gram, self.size)
            some = np.flatnonzero(self.bits[a >> 3] >> (a & 7).astype(np.uint8) & 1)
            some = some[(self.bits[b[some] >> 3] >> (b[some] & 7).astype(np.uint8) & 1).astype(bool)]
            for k in places:
                out[at[some] + k] = True
        return out


def _frequencies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    copied = shared.value
    cells = 1 << WORD_BITS
    sums = np.zeros(cells + BLOCKS, np.int64)
    for rows in batches:
        for _, _, raw, off in chunks(rows.column(0)):
            h, first = _words(raw, off)
            passage, count = _passage_ids(first, PASSAGE)
            both = np.sort((passage << WORD_BITS | _bucket(h))[~copied.words(h, first)])
            once = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
            np.add.at(sums, once & (cells - 1), 1)
            sums[cells] += count
    block, packed = pack_blocks(sums[:cells], BLOCKS)
    if sums[cells]:
        block = pa.concat_arrays([block, pa.array([BLOCKS], pa.int32())])
        packed = pa.concat_arrays([packed, pack_blocks(np.full((1, cells // BLOCKS), sums[cells]), 1)[1]])
        yield pa.RecordBatch.from_arrays([block, packed], names=["block", "sums"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of a task's words, each once a batch."""
    for rows in batches:
        yield batch(bucket=pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *(_bucket(_words(raw, off)[0]) for _, _, raw, off in chunks(rows.column(0)))]))))


class Vocabulary:
    """The benchmark's words: column of each bucket (or -1) and inverse passage frequency of each column."""

    def __init__(self, used: np.ndarray, often: np.ndarray, passages: int):
        self.column = np.full(1 << WORD_BITS, -1, np.int32)
        self.column[used] = np.arange(len(used))
        self.weight = np.log((passages + 2) / (often[used] + 1))
        self.weight = np.maximum(self.weight - np.log(10), 0.02)  # words of a tenth of all passages and more say almost nothing
        self.size = len(used)

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = self.column[_bucket(h)]
        where = np.flatnonzero(column >= 0)
        return where, column[where]


def _rows(h, first, vocabulary: Vocabulary):
    """Unit TF-IDF rows of the passages: (passage starts among the entries, columns, values)."""
    passage, _ = _passage_ids(first, PASSAGE)
    where, column = vocabulary.known(h)
    if not len(where):
        return np.zeros(0, np.int64), column, np.zeros(0)
    owner = passage[where]
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    value = vocabulary.weight[column]
    norm = np.sqrt(np.add.reduceat(value * value, start))
    return start, column, value / np.repeat(norm, np.diff(np.append(start, len(owner))))


def _padded(sums: np.ndarray) -> np.ndarray:
    """The sums, with zeros after them that make their number a multiple of ``BLOCKS``."""
    return np.append(sums.ravel(), np.zeros(-sums.size % BLOCKS))


def _multiplied(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Sums over passages a with weights w of w a (a basis)."""
    vocabulary, basis = shared.value
    sums = np.zeros((vocabulary.size, basis.shape[1]))
    for rows in batches:
        weights = rows.column(1).to_numpy()
        for lo, hi, raw, off in chunks(rows.column(0)):
            h, first = _words(raw, off)
            start, column, value = _rows(h, first, vocabulary)
            if not len(start):
                continue
            where, _ = vocabulary.known(h)
            weight = weights[lo + np.searchsorted(first, where, "right") - 1] * value
            ends = np.append(start, len(column))
            cuts = ends[np.unique(np.searchsorted(ends, np.append(np.arange(0, len(column), ENTRIES), len(column))))]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # whole passages
                begin = ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] - a
                own = column[a:b]
                z = np.add.reduceat(value[a:b, None].astype(np.float32) * basis[own], begin)
                passage = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, b - a)))
                order = np.argsort(own, kind="stable")
                own = own[order]
                words = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                sums[own[words]] += np.add.reduceat(weight[a:b, None][order].astype(np.float32) * z[passage[order]], words)
    block, packed = pack_blocks(_padded(sums), BLOCKS, "<f4")
    yield pa.RecordBatch.from_arrays([block, packed], names=["block", "sums"])


def latent_basis(rows: DataFrame, items: DataFrame, vocabulary: Vocabulary, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (words x rank) of the weighted passages of ``rows`` (text, weight); ``items`` are those of them that weigh most."""
    context = rows.sparkSession.sparkContext
    width = min(rank + EXTRA, vocabulary.size)
    size = vocabulary.size * width
    rng = np.random.default_rng(11)

    def times(df: DataFrame, basis: np.ndarray) -> np.ndarray:
        shared = context.broadcast((vocabulary, basis.astype(np.float32)))
        parts = df.select("text", "weight").mapInArrow(lambda it: _multiplied(it, shared), "block int, sums binary")
        out = add_blocks(parts, BLOCKS, size + -size % BLOCKS, "<f4")[:size].reshape(-1, width).astype(np.float64)
        shared.unpersist()
        return out

    basis = np.linalg.qr(rng.normal(size=(vocabulary.size, width)))[0]
    for _ in range(ROUNDS):
        made = times(items, basis)
        # few items span less than the basis: the rest of it is left to chance
        basis = np.linalg.qr(made + 1e-3 * np.abs(made).max() * rng.normal(size=made.shape) / np.sqrt(vocabulary.size))[0]
    made = times(rows, basis)
    values, vectors = np.linalg.eigh((basis.T @ made + made.T @ basis) / 2)
    some = values > 1e-6 * values.max()
    made = made @ (vectors[:, some] / np.sqrt(values[some]))  # made made' is about the passages' square
    values, vectors = np.linalg.eigh(made.T @ made)
    top = np.argsort(-values)[: min(rank, width)]
    top = top[values[top] > 1e-6 * values.max()]
    return made @ (vectors[:, top] / np.sqrt(values[top]))


def masks_of(item: np.ndarray) -> dict[int, int]:
    """The places of each word of the item, a bit for each."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


def common_subsequence(item: np.ndarray, text: np.ndarray, masks: dict[int, int] | None = None) -> int:
    """Words of the longest common subsequence, a bit for each word of the item."""
    masks = masks_of(item) if masks is None else masks
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


class Item:
    """An item's words and answer, ready to be looked for."""

    def __init__(self, own: np.ndarray, answer: np.ndarray):
        self.own, self.answer, self.words = own, answer, np.unique(own)
        self.masks, self.answer_masks = masks_of(own), masks_of(answer)

    def share_in(self, text: np.ndarray) -> float:
        """The greatest share of the item's words, in order, that a stretch of ``text`` holds; 0 if that is no leak.

        Stretches are ``LOOSENESS`` times as long as the item and start every half of its length.
        """
        n, best = len(self.own), 0.0
        if n < LEAST:
            whole = np.lib.stride_tricks.sliding_window_view(text, n) if len(text) >= n else text[:0].reshape(0, n)
            return float(bool((whole == self.own).all(1).any()))
        there = np.flatnonzero(self.words[np.minimum(np.searchsorted(self.words, text), len(self.words) - 1)] == text)
        if len(there) < LOOSE * n:
            return 0.0
        size, step = LOOSENESS * n, max(1, n // 2)
        begin = np.arange(0, max(1, len(text) - size + step), step)
        first, last = np.searchsorted(there, begin), np.searchsorted(there, begin + size)
        for k in np.argsort(first - last, kind="stable").tolist():  # those with most of its words first
            if last[k] - first[k] < max(best, LOOSE) * n:
                break
            part = text[there[first[k] : last[k]]]  # the item's words in it
            share = common_subsequence(self.own, part, self.masks) / n
            if share > best and (share >= LCS or share >= LOOSE and common_subsequence(self.answer, part, self.answer_masks) >= LCS * len(self.answer)):
                best = share
        return best


def answer_of(text: str) -> np.ndarray:
    """The last sentence of at least ``ANSWER_WORDS`` words, else the last words."""
    for part in reversed((text or "").replace("?", ".").replace("!", ".").replace("\n", ".").split(".")):
        words = words_of(part)
        if len(words) >= ANSWER_WORDS:
            return words
    return words_of(text)[-ANSWER_WORDS:]


def pieces_of(items: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(even pieces of at most ``PASSAGE`` words, the item of each, its first word there)."""
    cut = [np.array_split(w, -(-len(w) // PASSAGE)) for w in items]
    owner = np.repeat(np.arange(len(items)), [len(parts) for parts in cut])
    return [x for parts in cut for x in parts], owner, np.concatenate([np.cumsum([0, *map(len, parts[:-1])]) for parts in cut])


def _searched(batches: Iterator[pa.RecordBatch], shared, of) -> Iterator[pa.RecordBatch]:
    vocabulary, projection = shared.value
    latents, norms, owners, offsets, items, answers, ids = of.value
    directions = np.divide(latents, norms[:, None], out=np.zeros_like(latents), where=norms[:, None] > 0).T.astype(np.float32)
    least = np.where(norms > 0, SHARE * norms, np.inf).astype(np.float32)
    ready: dict[int, Item] = {}
    for rows in batches:
        for lo, hi, raw, off in chunks(rows.column(1), 1 << 19):
            h, first = _words(raw, off)
            unit, units = _passage_ids(first, UNIT)
            where, column = vocabulary.known(h)
            if not len(where):
                continue
            z = np.zeros((units + 1, projection.shape[1]), np.float32)
            owner = unit[where]
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            z[owner[start]] = np.add.reduceat(projection[column], start)
            parts = -(-np.diff(first) // UNIT)
            base = np.cumsum(parts) - parts
            doc = np.repeat(np.arange(hi - lo), parts)
            found: dict[tuple[int, int], tuple[float, int, int]] = {}
            seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for span in SPANS:
                total = z[:units].copy()
                for k in range(1, span):  # units after it, in the same document
                    same = np.flatnonzero(doc[k:] == doc[:-k])
                    total[same] += z[same + k]
                length = COSINE * np.linalg.norm(total, axis=1)
                for low in range(0, units, PASSAGES):
                    along = total[low : low + PASSAGES] @ directions
                    some, item = np.nonzero((along >= least) & (along >= length[low : low + PASSAGES, None]))
                    for p, j in zip((some + low).tolist(), item.tolist(), strict=True):
                        d, i = int(doc[p]), int(owners[j])
                        own, at = items[i], int(p - base[d]) * UNIT
                        before = after = UNIT + max(PASSAGE, len(own)) // 2
                        if len(own) > PASSAGE:  # what the item has before and after the piece, and some more
                            rest = len(own) - int(offsets[j])
                            before, after = max(before, UNIT + int(offsets[j]) * 5 // 4), max(after, UNIT + rest * 5 // 4)
                        begin, end = max(0, at - before), min(int(first[d + 1] - first[d]), at + span * UNIT + after)
                        if len(own) > PASSAGE:  # passages of one copy ask for about the same words
                            begin, end = begin // PASSAGE * PASSAGE, min(int(first[d + 1] - first[d]), -(-end // PASSAGE) * PASSAGE)
                        if (d, i) in found and found[d, i][0] == 1.0 or any(x <= begin and end <= y for x, y in seen.get((d, i), ())):
                            continue
                        seen.setdefault((d, i), []).append((begin, end))
                        if i not in ready:
                            ready[i] = Item(own, answers[i])
                        share = ready[i].share_in(h[first[d] + begin : first[d] + end])
                        if share > found.get((d, i), (0.0,))[0]:
                            found[d, i] = (share, begin, end)
            if found:
                docs = pa.array([lo + d for d, _ in found])
                yield pa.RecordBatch.from_arrays([rows.column(0).take(docs), pa.array([ids[i] for _, i in found], pa.int64()), *(pa.array([x[k] for x in found.values()], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64())))], names=["doc_id", "item_id", "lcs", "begin_word", "end_word"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, lcs (share of the item's words), and the words searched."""
    spark = docs.sparkSession
    stage = Stage(spark, "leaks")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, lcs double, begin_word long, end_word long"
    cells = 1 << WORD_BITS
    asked = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.lower(F.col(item_text_col)).alias("text")).filter("item_id is not null and text is not null")
    count = asked.count()
    blocks = max(1, -(-count // ITEMS))
    parts = [asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) for block in range(blocks)]
    copied = Copied(int(asked.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0))
    for part in parts:  # at most about ITEMS items are on the driver at a time
        copied.add([words_of(r.text) for r in part.select("text").collect()])
    used = np.sort(np.array([r.bucket for r in asked.select("text").mapInArrow(_buckets, "bucket long").distinct().collect()], np.int64))
    if not len(used):
        return spark.createDataFrame([], schema)
    grams = spark.sparkContext.broadcast(copied)
    counts = add_blocks(docs.select("text").mapInArrow(lambda it: _frequencies(it, grams), "block int, sums binary"), BLOCKS + 1, cells + cells // BLOCKS)
    vocabulary = Vocabulary(used, counts[:cells], int(counts[cells]))
    # rows that repeat count once: each copy has its share
    again = stage.write(docs.filter("text is not null").groupBy(F.xxhash64("text").alias("digest")).agg(F.count("*").alias("copies")).filter("copies > 1"), "again")
    spare = int(again.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    rows = docs.select("text", F.lit(1.0).alias("weight"))
    if spare:
        rows = docs.withColumn("digest", F.xxhash64("text")).join(bounded(again), "digest", "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    weight = max(1.0, (docs.count() - spare) * 8.0 / count)
    items = asked.select("text", F.lit(weight).alias("weight"))
    projection = (latent_basis(rows.unionByName(items), items, vocabulary) * vocabulary.weight[:, None]).astype(np.float32)
    shared = spark.sparkContext.broadcast((vocabulary, projection))

    out = None
    for part in parts:
        rows = [(r.item_id, r.text, words_of(r.text)) for r in sorted(part.collect())]
        rows = [r for r in rows if len(r[2])]
        if not rows:
            continue
        items = [r[2] for r in rows]
        pieces, owners, offsets = pieces_of(items)
        latents = np.array([projection[vocabulary.known(w)[1]].sum(0) for w in pieces])
        of = spark.sparkContext.broadcast((latents, np.linalg.norm(latents, axis=1), owners, offsets, items, [answer_of(r[1]) for r in rows], [r[0] for r in rows]))
        found = docs.mapInArrow(lambda it, of=of: _searched(it, shared, of), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
