"""Shared plumbing of the training-data operators: tables, staging and hash kernels.

Everything that outlives a job goes to the folder that the cluster names in ``spark.checkpoint.dir``. Only a session
on a single machine (a local master) may leave it unset, and then gets a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join with at most this many rows (of a few dozen bytes each) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000

#: Bytes of text that a kernel looks at together; one longer document is still handled whole.
CHUNK_BYTES = 1 << 20

#: So many neighbouring tasks' sums of a block are added up by one task.
TASKS_ADDED = 256

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set to a temporary one only where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loquat-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Stage:
    """Tables written to the shared folder to cut lineage; each read survives the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/loquat-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete staged tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (staged, a few dozen bytes a row) marked for broadcast if it is counted to be small, else unchanged."""
    limit = BROADCAST_ROWS if rows is None else rows
    small = df.limit(limit + 1).count() <= limit if limit > 0 else False
    return F.broadcast(df) if small else df


def join_few(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Inner join with a staged side that has one row a key. Where its keys are counted to be few, rows of ``df`` that they don't name leave before the shuffle."""
    keys = side.select(key)
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        df = df.join(F.broadcast(keys), key, "left_semi")
    return df.join(side, key)


def numbered(docs: DataFrame, id_col: str, text_col: str, stage: Stage, nulls_first: bool = True) -> DataFrame:
    """(_doc, _row): each row with a long that names its document.

    That is the id, if ids are whole numbers of which none is missing or repeats. Else it counts the distinct pairs of
    id and text in the order of the id, then of a digest of the text; so rows that are equal in both are one document.
    """
    key = F.col(f"`{id_col}`")
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and not docs.groupBy(key.alias("id")).count().filter("count > 1 or id is null").limit(1).count():
        return docs.select(key.cast("long").alias("_doc"), F.struct("*").alias("_row"))
    digest = F.xxhash64(F.col(f"`{text_col}`"))
    order = [F.col("id").isNotNull() if nulls_first else F.col("id").isNull(), F.col("id"), F.col("digest")]
    keys = docs.select(key.alias("id"), digest.alias("digest")).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    keys = stage.write(keys.withColumn("_doc", F.monotonically_increasing_id()), "keys")
    rows = docs.select(F.struct("*").alias("_row"), key.alias("own_id"), digest.alias("own_digest"))
    rows = rows.join(keys, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest")))
    return stage.write(rows.select("_doc", "_row"), "numbered")


# ---- text in Arrow batches ------------------------------------------------


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string()) if column.nbytes < (1 << 31) - 1 else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over whole documents, about ``limit`` bytes at a time."""
    raw, off = texts(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def slices(rows: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text in a column; a longer text is a slice by itself."""
    _, ends = texts(rows.column(column))
    lo = 0
    while lo < rows.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield rows.slice(lo, hi - lo)
        lo = hi


# ---- 64-bit hashes --------------------------------------------------------

_BASE = U64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES + 8), U64(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def byte_classes(breaks: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a separator, hash value) by byte; with ``lower``, A-Z have the values of a-z."""
    is_break = np.zeros(256, bool)
    is_break[list(breaks)] = True
    values = _BYTE_VALUES.copy()
    if lower:
        values[65:91] = values[97:123]
    return is_break, values


def word_hashes(raw: np.ndarray, off: np.ndarray, is_break: np.ndarray, values: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between separators, never across documents: (hashes, start bytes, end bytes, first word of each document + end).

    With ``kinds`` (a number for each byte) a word also ends where the kind changes.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    inside = ~is_break[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    if kinds is not None:
        kind = kinds[raw]
        edge[1:n] |= kind[1:] != kind[:-1]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[raw] * up, out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(s, off)


def shingle_sets(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each document, sorted by hash: (hashes, first shingle of each document + end).

    A document of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    docs, n = len(first) - 1, len(h)
    words = np.diff(first)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    acc = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        acc = mix(acc * U64(0xD6E8FEB86659FD93) + h[k : k + len(acc)])
    counts = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    begin = np.zeros(docs + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    out = np.empty(begin[-1], np.uint64)
    keep = np.ones(begin[-1], bool)
    for d in range(docs):
        a, b, w = begin[d], begin[d + 1], first[d]
        if words[d] >= size:
            out[a:b] = acc[w : w + b - a]
            out[a:b].sort()
        elif words[d]:
            one = words[d : d + 1].astype(np.uint64)
            for k in range(w, w + words[d]):
                one = mix(one * U64(0xA0761D6478BD642F) + h[k : k + 1])
            out[a] = one[0]
    if len(out):
        keep[1:] = out[1:] != out[:-1]
        keep[begin[:-1][counts > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[begin]


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pack_blocks(values: np.ndarray, blocks: int, dtype: str = "<i8") -> tuple[pa.Array, pa.Array]:
    """(block, zipped sums) of the blocks of a task's sums that aren't all zero."""
    parts = values.reshape(blocks, -1)
    used = np.flatnonzero(parts.any(1))
    return pa.array(used, pa.int32()), pa.array([zlib.compress(parts[k].astype(dtype).tobytes(), 1) for k in used], pa.binary())


def _add_blocks(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for rows in batches:
        for k, blob in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            more = np.frombuffer(zlib.decompress(blob.as_buffer()), dtype)
            sums[k] = sums[k] + more if k in sums else more
    if sums:
        yield batch(block=pa.array(list(sums), pa.int32()), sums=pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary()))


def add_blocks(df: DataFrame, blocks: int, size: int, dtype: str = "<i8") -> np.ndarray:
    """The tasks' sums (block, sums) added up by the executors; ``size`` numbers come to the driver, whatever the input.

    Those of ``TASKS_ADDED`` neighbouring tasks are added first, then what that gives, so that no reducer reads a blob of
    each task; both times a batch is held at a time.
    """
    adding = lambda parts: parts.mapInArrow(lambda it: _add_blocks(it, dtype), "block int, sums binary")
    parts = df.toDF("block", "sums").withColumn("near", F.floor(F.spark_partition_id() / TASKS_ADDED))
    parts = adding(parts.repartition("block", "near").select("block", "sums"))
    out = np.zeros((blocks, size // blocks), dtype)
    for r in adding(parts.repartition(blocks, "block")).collect():
        out[r.block] += np.frombuffer(zlib.decompress(r.sums), dtype)
    return out.ravel()


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
