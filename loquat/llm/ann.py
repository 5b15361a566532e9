"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors are centred, rotated to their principal axes and then by the rotation that brings them nearest to
the corners of a cube (iterative quantisation); the signs are the code. The rotation is learned from a sample of
about ``FIT_ROWS`` rows chosen by a hash of the id.

Radius: on the same sample, the Hamming radius within which ``TARGET`` of the true neighbours of some rows lie. In
a larger table neighbours are nearer, so it errs on the safe side.

Index: rows stay where they are read. A task gathers blocks of ``BLOCK_ROWS`` rows; within a block the codes are cut
into ``PARTS`` substrings, each indexed by its value. Two codes within radius r agree to within r // PARTS bits in one of
their substrings, so probing the values within that many bits retrieves every code within r. Codes found are checked
against the whole radius and reranked by distance in double precision. While a query has found fewer than k rows, its
radius grows by PARTS until there are k, or all of the block.

Queries are sent to all tasks, in blocks of at most ``BLOCK_QUERIES`` and ``BLOCK_BYTES``, whatever their number. A task
keeps the k best of each query over all its blocks, so what is shuffled is k rows for each query and task; tasks are
about as many as the cluster has cores, not as the table has rows. No row or vector of the table is shuffled, and no
bucket, however common, is in one task.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do those
of another length than most (the smaller of equals), nor rows without id; ties go to the smaller id; rows that
repeat an id are each a candidate of others, and of queries that share an id the smallest vector is asked; with fewer than k candidates all are returned; ids are whole numbers; other
columns are ignored, whatever their names; there is no text; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, table

K = 10
FIT_ROWS = 8_000
TARGET = 0.97
PARTS = 8
BLOCK_ROWS = 20_000
#: Queries that are broadcast together.
BLOCK_QUERIES, BLOCK_BYTES = 100_000, 64 << 20
#: Tasks for each core of the cluster.
TASKS = 4


class Codes:
    """Centre and rotation; codes are rows of bytes, one substring a byte (dimensions are padded to a multiple of 8)."""

    def __init__(self, sample: np.ndarray, rounds: int = 30, seed: int = 5):
        self.centre = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
        z = sample - self.centre
        dims = sample.shape[1]
        axes = np.linalg.eigh(z.T @ z)[1].T[::-1]  # principal axes, the widest first
        spin = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]
        v = z @ axes.T
        for _ in range(rounds if len(sample) > 1 else 0):
            a, _, b = np.linalg.svd(np.where(v @ spin >= 0, 1.0, -1.0).T @ v)
            spin = (a @ b).T
        self.turn = axes.T @ spin
        self.radius = dims

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.turn >= 0, axis=1)


def calibrated(sample: np.ndarray, k: int, target: float) -> Codes:
    codes = Codes(sample)
    if len(sample) > 2 * k:
        queries = sample[:: max(1, len(sample) // 200)][:200]
        far = ((queries**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * queries @ sample.T)
        near = np.argpartition(far, k, axis=1)[:, : k + 1]
        a, b = codes.encode(queries), codes.encode(sample)
        bits = np.bitwise_count(a[:, None, :] ^ b[near]).sum(2)
        codes.radius = int(np.ceil(np.quantile(bits, target)))
    return codes


def probe(index: list[tuple[np.ndarray, np.ndarray, np.ndarray]], codes: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """Rows whose code is within ``radius`` of the query's: in some substring within radius // substrings bits."""
    hit = np.zeros(len(codes), bool)
    for part, (values, edges, rows) in enumerate(index):
        for v in np.flatnonzero(np.bitwise_count(values ^ query[part]) <= radius // len(index)).tolist():
            hit[rows[edges[v] : edges[v + 1]]] = True
    rows = np.flatnonzero(hit)
    return rows[np.bitwise_count(codes[rows].view(np.uint64) ^ query.view(np.uint64)).sum(1) <= radius] if codes.shape[1] % 8 == 0 else rows[np.bitwise_count(codes[rows] ^ query).sum(1) <= radius]


def index_of(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for part in range(codes.shape[1]):
        rows = np.argsort(codes[:, part], kind="stable")
        values, edges = np.unique(codes[rows, part], return_index=True)
        out.append((values, np.append(edges, len(rows)), rows))
    return out


class Best:
    """The k nearest rows of each query so far, of ties the smaller ids."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, codes: Codes, k: int):
        self.ids, self.q, self.codes, self.k = ids, q, codes, k
        self.asked = codes.encode(q)
        self.distance = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Search a block of rows."""
        own, k = self.codes.encode(x), self.k
        index, norms = index_of(own), (x * x).sum(1)
        for i, (query, vector, code) in enumerate(zip(self.ids.tolist(), self.q, self.asked, strict=True)):
            radius, worst = self.codes.radius, self.distance[i, -1]
            while True:
                rows = probe(index, own, code, radius)
                rows = rows[ids[rows] != query]
                if len(rows) >= k or np.isfinite(worst) or radius >= 8 * own.shape[1]:
                    break
                radius += own.shape[1]
            # a product first; what it can't tell apart goes on
            rough = norms[rows] - 2 * (x[rows] @ vector)
            size = float(vector @ vector)
            bound = min(np.partition(rough, k - 1)[k - 1] if len(rows) > k else np.inf, worst * worst - size)
            rows = rows[rough <= bound + 1e-9 * (1 + min(abs(bound), size + worst * worst) + size)]
            if not len(rows):
                continue
            gap = x[rows] - vector
            distance = np.append(self.distance[i], np.sqrt((gap * gap).sum(1)))
            found = np.append(self.found[i], ids[rows])
            first = np.lexsort((found, distance))[:k]
            self.distance[i], self.found[i] = distance[first], found[first]

    def rows(self) -> pa.RecordBatch:
        some = np.isfinite(self.distance)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, some.sum(1))), pa.array(self.found[some]), pa.array(self.distance[some])], names=["query_id", "vec_id", "score"])


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(rows, -1)


def _scanned(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) of a task to the k nearest of them for each of the queries."""
    codes, query_ids, q = shared.value
    best, held, size = Best(query_ids, q, codes, k), [], 0

    def search() -> None:
        rows = pa.Table.from_batches(held)
        best.add(rows.column(0).to_numpy(), _matrix(rows.column(1).combine_chunks(), rows.num_rows))

    for rows in batches:
        for at in range(0, rows.num_rows, BLOCK_ROWS):
            part = rows.slice(at, BLOCK_ROWS)
            held.append(part)
            size += part.num_rows
            if size >= BLOCK_ROWS:
                search()
                held, size = [], 0
    if size:
        search()
    yield best.rows()


def search(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` found for each of ``queries`` (both: id, vector); a query never finds rows of its own id."""
    spark = vectors.sparkSession
    stage = Stage(spark, "ann")

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))

    rows, asked = usable(vectors), usable(queries)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = sizes[0]["d"], sizes[0]["count"]
    rows, asked = rows.filter(F.size("vector") == dims), asked.filter(F.size("vector") == dims)
    share = int(min(1.0, FIT_ROWS / total) * (1 << 30))
    fit = rows.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < share).distinct().collect()  # about FIT_ROWS rows; rows that repeat count once
    sample = np.array([r.vector for r in sorted(fit)], np.float64).reshape(-1, dims)
    codes = calibrated(sample, k, TARGET)

    asked = stage.write(asked.groupBy("id").agg(F.min("vector").alias("vector")), "asked")
    blocks = max(1, -(-asked.count() // min(BLOCK_QUERIES, max(1, BLOCK_BYTES // (8 * dims)))))
    tasks = max(1, TASKS * spark.sparkContext.defaultParallelism)
    paths = []
    for block in range(blocks):
        part = sorted(asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect())
        q = np.array([r.vector for r in part], np.float64).reshape(-1, dims)
        shared = spark.sparkContext.broadcast((codes, np.array([r.id for r in part], np.int64), q))
        scanned = rows.select("id", "vector").coalesce(tasks).mapInArrow(lambda it, shared=shared: _scanned(it, shared, k), "query_id long, vec_id long, score double")
        stage.write(scanned, f"best-{block}")
        paths.append(stage.path(f"best-{block}"))
        shared.unpersist()
    stage.drop("asked")
    best = spark.read.schema("query_id long, vec_id long, score double").parquet(*paths)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding")
