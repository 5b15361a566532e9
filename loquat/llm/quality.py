"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

1. One pass over all documents learns the word vectors: each word (a run of letters and digits, or of other
   marks; case counts) has a fixed sparse index vector from its hash, and a word's vector is the sum of the
   index vectors of its neighbours, two to either side, over the whole corpus. Words share 2**15 hashed rows,
   so the table has one size whatever the input.
2. A document is the mean, the spread and the neighbour product of its words' vectors, frequent words
   weighing less.
3. A network with one hidden layer (numpy) is trained on at most about ``TRAIN_ROWS`` labelled documents,
   chosen by a hash of their id. A fifth of them is kept from training to fit the temperature by which logits
   are divided.
4. One more pass scores every whole text.

Defined cases: null and empty texts have zero features and get a score like any other; a very long text is one row's
work; equal texts have equal scores, so there are no ties to break; rows that repeat, or have no id, are each scored; of
rows that share a labelled id one is learned from (the smallest by its features); ids are of any type; labels other than
0 and 1 and labels of unknown documents are ignored, and of several labels of an id the smaller counts; with no label
of one of the two kinds, each score is the share of label 1 (0.5 with no label at all); an empty table gives no row;
other columns are passed on, whatever their names, but for ``score``, which the result's replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Stage, add_blocks, batch, byte_classes, chunks, mix, pack_blocks, table, word_hashes

ROW_BITS, DIMS = 15, 32
BLOCKS = 64
#: Labelled rows that the network learns from, about.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
SHRINK = 6.0  # words
CALIBRATION = 5  # one labelled row in so many
_SPACE = bytes(range(33)) + b"\x7f"
_KINDS = np.zeros(256, np.int8)
for _b in range(256):
    _KINDS[_b] = 1 if _b >= 128 or chr(_b).isalnum() else 2


def _tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    is_break, values = byte_classes(_SPACE, lower=False)
    h, _, _, first = word_hashes(raw, off, is_break, values, _KINDS)
    return h, (h & U64((1 << ROW_BITS) - 1)).astype(np.int64), first


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums: DIMS for each row, then how often each row occurs."""
    cells = DIMS << ROW_BITS
    sums = np.zeros(cells + (1 << ROW_BITS), np.int64)
    for rows in batches:
        for _, _, raw, off in chunks(rows.column(0)):
            h, row, first = _tokens(raw, off)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            sums[cells:] += np.bincount(row, minlength=1 << ROW_BITS)
            g = mix(h + U64(0x632BE59BD9B4E019))
            places = [((g >> U64(8 * k)) & U64(DIMS - 1)).astype(np.int64) for k in range(2)]
            signs = [1.0 - 2.0 * ((g >> U64(40 + k)) & U64(1)).astype(np.float64) for k in range(2)]
            for step in (1, 2):
                near = doc[step:] == doc[:-step]
                for a, b in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                    base = row[a][near] * DIMS
                    for place, sign in zip(places, signs, strict=True):
                        sums[:cells] += np.bincount(base + place[b][near], sign[b][near], minlength=cells).astype(np.int64)
    block, packed = pack_blocks(sums, BLOCKS)
    if len(block):
        yield pa.RecordBatch.from_arrays([block, packed], names=["block", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, pooling weights) of the hashed rows, from all documents."""
    parts = docs.select(F.col(f"`{text_col}`")).mapInArrow(_neighbours, "block int, sums binary")
    sums = add_blocks(parts, BLOCKS, (DIMS + 1) << ROW_BITS).astype(np.float64)
    vectors, often = sums[: DIMS << ROW_BITS].reshape(-1, DIMS), sums[DIMS << ROW_BITS :]
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    weights = 1e-3 / (1e-3 + often / max(often.sum(), 1.0))
    return vectors.astype(np.float32), weights.astype(np.float32)


def pooled(raw: np.ndarray, off: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """3 * DIMS + 1 features a document."""
    _, row, first = _tokens(raw, off)
    docs = len(first) - 1
    out = np.zeros((docs, 3 * DIMS + 1), np.float32)
    words = np.diff(first)
    full = words > 0
    if not full.any():
        return out
    at = first[:-1][full]
    w = weights[row][:, None]
    v = vectors[row]
    total = np.maximum(np.add.reduceat(w, at), 1e-9)
    mean = np.add.reduceat(v * w, at) / total
    square = np.add.reduceat(v * v * w, at) / total
    pair = np.zeros_like(v)
    pair[:-1] = v[:-1] * v[1:]
    pair[first[1:][full] - 1] = 0  # the next word is another document's
    out[full, :DIMS] = mean
    out[full, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[full, 2 * DIMS : 3 * DIMS] = np.add.reduceat(pair, at) / np.maximum(words[full] - 1, 1)[:, None]
    out[full, -1] = np.log1p(words[full])
    return out


def _features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    vectors, weights = model.value
    for rows in batches:
        for lo, hi, raw, off in chunks(rows.column(0), 1 << 18):
            x = pooled(raw, off, vectors, weights)
            yield pa.RecordBatch.from_arrays([rows.column(1).slice(lo, hi - lo), rows.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])


class Network:
    """Standardised inputs, tanh units, one logit; ``temperature`` divides it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.constant = None if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.5
        self.temperature = 1.0
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        held = np.arange(len(y)) % CALIBRATION == 0
        if min(y[~held].sum(), (1 - y[~held]).sum()) == 0 or held.sum() < 20:
            held[:] = False
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = self._scaled(x)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        own = np.flatnonzero(~held)
        for _ in range(EPOCHS):
            for at in range(0, len(own), BATCH):
                pick = own[rng.integers(0, len(own), BATCH)]
                a, b = z[pick], y[pick]
                hidden = np.tanh(a @ p[0] + p[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - b) / len(pick)
                back = error[:, None] * p[2] * (1 - hidden**2)
                t += 1
                for k, g in enumerate((a.T @ back + DECAY * p[0], back.sum(0), hidden.T @ error + DECAY * p[2], np.array([error.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= RATE * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p = [a.astype(np.float64) for a in p]
        some = held if held.any() else ~held
        logits, truth = self._logit(z[some]), y[some]

        def loss(temperature: float) -> float:
            s = logits / temperature
            return float(np.mean(np.logaddexp(0, s) - truth * s))

        self.temperature = min(np.exp(np.linspace(-2, 3, 101)), key=loss)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        """Few words say little: their pooled vectors are drawn towards the mean."""
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8)
        words = np.expm1(x[:, -1:].astype(np.float64))
        z[:, :-1] *= words / (words + SHRINK)
        return z

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(self._scaled(x)) / self.temperature, -500, 500)))


def _scored(batches: Iterator[pa.RecordBatch], model, text: int) -> Iterator[pa.RecordBatch]:
    """Rows (_row [, _text]) to (_row, _score); the text is in the struct, at place ``text``, or, if that is -1, beside it."""
    vectors, weights, network = model.value
    for rows in batches:
        column = rows.column(1) if text < 0 else rows.column(0).flatten()[text]
        for lo, hi, raw, off in chunks(column, 1 << 18):
            score = network.score(pooled(raw, off, vectors, weights))
            yield batch(_row=rows.column(0).slice(lo, hi - lo), _score=pa.array(score))


def held_out(id_col: str) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int) -> tuple[np.ndarray, np.ndarray, Network]:
    """(word vectors, pooling weights, network)."""
    spark = docs.sparkSession
    stage = Stage(spark, "quality")
    vectors, weights = word_vectors(docs, text_col)
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    share = min(1.0, train_rows / max(total, 1))
    known = stage.write(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))), "labels")  # about train_rows rows, so it may be broadcast
    model = spark.sparkContext.broadcast((vectors, weights))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "doc_id").select("text", "doc_id", "quality")
    kind = docs.schema[id_col].dataType.simpleString()
    features = rows.mapInArrow(lambda it: _features(it, model), f"doc_id {kind}, quality int, x binary")
    # one row a labelled id, however often it stands in the table: about train_rows of them come to the driver
    learned = stage.write(features.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("doc_id", "r.x", "r.quality"), "features")
    seen = sorted(learned.collect(), key=lambda r: (hash_order(r.doc_id), r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in seen], np.float32).reshape(-1, 3 * DIMS + 1)
    stage.drop("labels", "features")
    return vectors, weights, Network(x, np.array([r.quality for r in seen], np.float64))


def scored_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """(_row: the row of ``docs``, or its columns ``keep``; _score: from 0 to 1)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col, train_rows))
    keep = docs.columns if keep is None else keep
    place = keep.index(text_col) if text_col in keep else -1
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), *([F.col(f"`{text_col}`").alias("_text")] if place < 0 else []))
    schema = T.StructType([rows.schema["_row"], T.StructField("_score", T.DoubleType())])
    return rows.mapInArrow(lambda it: _scored(it, model, place), schema)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The columns of every document, or those of ``keep``, and ``score``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    scored = scored_rows(docs, labels, id_col, text_col, label_col, train_rows, keep)
    return scored.select(*(F.col(f"_row.`{c}`") for c in keep), F.col("_score").alias("score"))


def hash_order(doc_id) -> int:
    """A fixed shuffle of ids, so that batches and the calibration rows don't follow their order."""
    return int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest(), "little")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
