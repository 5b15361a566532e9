"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Words are runs of bytes other than white space, A-Z lower-cased; a document's set is its distinct
shingles of ``size`` words (its whole sequence as one, if it has fewer). Two documents link when
``den * |intersection| >= num * |union|``.

1. One pass makes a row per document (set size, a 64-bit digest of the *set*, and a sketch: how many
   shingles fall in each of 32 parts of the hash space) and counts shingles over all documents in 2**20
   hashed counters. Documents with equal sets are one class from here on: copies never meet each other.
2. Shingles are ordered by (counter, hash), rarest first. A class of n shingles that links with anything
   shares at least ceil(num*n/den) of them, so any link shows in the first n - ceil(num*n/den) + 1: only
   those go to the join.
3. Every class meets one class for each of its prefix shingles: that in which the shingle stands first. Rare
   shingles come first, so it is the one with the fewest changes of its own, the middle of a group of near
   copies. That is linear in the prefixes, whatever the size of a group. Pairs pass the length filter, the positional
   filter (in the form that holds at every shared shingle, not at the first alone) and the suffix filter (the sketches
   bound the intersection), and are verified once on the exact sets.
4. Verified links are contracted to components. Prefix shingles that still hold several components are
   joined with themselves across components only, with length, positional and suffix filters, and the
   pairs verified. So no link between components is lost, and no group is expanded into all its pairs. Where
   the number of links is asked for, this step takes the pairs within components too.

Defined cases: documents without words have size 0 and are their own component; null text is empty; rows
with a null id get their size and a null component; rows that repeat an id count as one document if their
texts are equal, and the smallest id of the component is theirs anyway; ids of another type than whole numbers are
numbered in their order; a very long text is one row's work, its set being built and compared by one task; columns
other than id and text are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Stage, add_blocks, as_long, batch, bounded, byte_classes, chunks, mix, numbered, pack_blocks, shingle_sets, table, word_hashes
from .graph import connected_components

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
FREQ_BITS = 20
FREQ_BLOCKS = 64
PARTS = 32


def _sets(raw, off, size):
    h, _, _, first = word_hashes(raw, off, *byte_classes(SPACE, lower=True))
    return shingle_sets(h, first, size)


def _classes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A digest of each set; of an empty one 0."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ U64(0x5851F42D4C957F2D)), out=total[1:])
    other = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + U64(0x14057B7EF767814F)), out=other[1:])
    n = np.diff(begin).astype(np.uint64)
    d = mix((total[begin[1:]] - total[begin[:-1]]) ^ mix(other[begin[1:]] - other[begin[:-1]])) + n
    return np.where(n > 0, d, U64(0))


def _profile(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << FREQ_BITS, np.uint32)
    for rows in batches:
        ids = rows.column(0)
        for lo, hi, raw, off in chunks(rows.column(1)):
            h, begin = _sets(raw, off, size)
            np.add.at(counts, (h & U64((1 << FREQ_BITS) - 1)).astype(np.int64), np.uint32(1))
            n = np.diff(begin)
            part = np.repeat(np.arange(hi - lo), n) * PARTS + (h >> U64(59)).astype(np.int64)
            sketch = np.bincount(part, minlength=(hi - lo) * PARTS).astype("<u4").reshape(-1, PARTS)
            m = hi - lo
            yield batch(doc_id=ids.slice(lo, m), n=pa.array(n), cls=pa.array(as_long(_classes(h, begin)), mask=n == 0), sketch=pa.array([x.tobytes() for x in sketch], pa.binary()), block=pa.nulls(m, pa.int32()), counts=pa.nulls(m, pa.binary()))
    block, packed = pack_blocks(counts, FREQ_BLOCKS)
    if m := len(block):
        yield batch(doc_id=pa.nulls(m, pa.int64()), n=pa.nulls(m, pa.int64()), cls=pa.nulls(m, pa.int64()), sketch=pa.nulls(m, pa.binary()), block=block, counts=packed)


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int, counts) -> Iterator[pa.RecordBatch]:
    rank = counts.value
    seen: set[int] = set()
    for rows in batches:
        for lo, hi, raw, off in chunks(rows.column(0)):
            h, begin = _sets(raw, off, size)
            classes = as_long(_classes(h, begin)).tolist()
            key = (rank[(h & U64((1 << FREQ_BITS) - 1)).astype(np.int64)].astype(np.uint64) << U64(40)) | (h >> U64(24))
            out, cls, sizes = [], [], []
            for d in range(hi - lo):
                a, b = int(begin[d]), int(begin[d + 1])
                if a == b or classes[d] in seen:
                    continue
                seen.add(classes[d])
                n = b - a
                own = key[a:b]
                own.sort()
                out.append(own[: n - -(-num * n // den) + 1])
                cls.append(classes[d])
                sizes.append(n)
            if out:
                lengths = np.array([len(x) for x in out])
                pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield batch(tok=pa.array(as_long(np.concatenate(out))), cls=pa.array(np.repeat(np.array(cls, np.int64), lengths)), at=pa.array(np.repeat(np.array(sizes, np.int64) << 32, lengths) | pos))


def _own_text(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of rows (cls, text), those whose set has that digest."""
    for rows in batches:
        for lo, hi, raw, off in chunks(rows.column(1)):
            same = as_long(_classes(*_sets(raw, off, size))) == rows.column(0).slice(lo, hi - lo).to_numpy()
            yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in rows.columns], names=["cls", "text"]).filter(pa.array(same))


def _verified(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    def sets(column: pa.Array) -> list[np.ndarray]:
        found = []
        for lo, hi, raw, off in chunks(column):
            h, begin = _sets(raw, off, size)
            found += [h[begin[d] : begin[d + 1]] for d in range(hi - lo)]
        return found

    for rows in batches:
        for part in range(0, rows.num_rows, 1000):
            some = rows.slice(part, 1000)
            a = some.column(0).to_numpy()
            _, first, where = np.unique(a, return_index=True, return_inverse=True)
            left, right = sets(some.column(2).take(pa.array(first))), sets(some.column(3))
            keep = []
            for k, y in enumerate(right):
                x = left[where[k]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(some.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sketch_overlap(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The suffix filter: in each part of the hash space the sets share at most the smaller count."""
    for rows in batches:
        if not rows.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<u4").reshape(-1, PARTS).astype(np.int64) for c in (2, 3))
        both = np.minimum(x, y).sum(1)
        keep = den * both >= num * (x.sum(1) + y.sum(1) - both)
        yield pa.RecordBatch.from_arrays(rows.columns[:2], names=["a", "b"]).filter(pa.array(keep))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, num: int = 85, den: int = 100, links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links).

    With ``links`` also n_links, the number of other documents that it links with. Every pair of different sets that
    share a prefix shingle is then filtered and verified, not those across components alone, so the work grows with
    the number of links between different sets; copies are counted by the sizes of their classes.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "jaccard")
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        rows = numbered(docs, "doc_id", "text", stage, nulls_first=False)
        linked = link_documents(rows.select("_doc", "_row.text"), "_doc", "text", size, num, den, links).distinct()
        names = rows.filter("_row.doc_id is not null").select(F.col("_doc").alias("component_id"), F.col("_row.doc_id").alias("component")).distinct()
        more = ["n_links"] if links else []
        linked = linked.join(names, "component_id", "left").select(F.col("doc_id").alias("_doc"), "n_shingles", "component", *more)
        out = rows.join(linked, "_doc").select("_row.doc_id", "n_shingles", F.col("component").alias("component_id"), *more)
        return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, n long, cls long, sketch binary, block int, counts binary"
    profile = stage.write(docs.mapInArrow(lambda it: _profile(it, size), schema), "profile")
    rows = profile.filter("block is null").select("doc_id", "n", "cls", "sketch")
    classes = stage.write(rows.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    counts = add_blocks(profile.filter("block is not null").select("block", "counts"), FREQ_BLOCKS, 1 << FREQ_BITS)
    rank = spark.sparkContext.broadcast((np.log2(counts + 1.0) * (1 << 18)).astype(np.uint32))  # 24 bits for any count

    n, pos = (lambda at: F.shiftright(at, 32)), (lambda at: F.col(at).bitwiseAND(F.lit((1 << 32) - 1)))
    prefixes = stage.write(docs.filter("doc_id is not null").select("text").mapInArrow(lambda it: _prefixes(it, size, num, den, rank), "tok long, cls long, at long"), "prefixes")
    shared = prefixes.groupBy("tok").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.min_by(F.struct("cls", "at"), pos("at")).alias("hub")).filter("lo <> hi").select("tok", F.col("hub.cls").alias("hub"), F.col("hub.at").alias("hub_at"))
    live = stage.write(prefixes.join(shared, "tok"), "live")
    stage.drop("prefixes")

    # ``at`` packs the size of the set and the place of the shingle in it
    size_of = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"k_{s}"))
    lengths = F.col("n_a") * den >= F.col("n_b") * num
    lengths &= F.col("n_b") * den >= F.col("n_a") * num

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """Links among distinct pairs a < b."""
        likely = pairs.join(size_of("a"), "a").join(size_of("b"), "b").filter(lengths).select("a", "b", "k_a", "k_b")
        likely = stage.write(likely.mapInArrow(lambda it: _sketch_overlap(it, num, den), "a long, b long"), f"{name}-likely")
        wanted = likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct()
        wanted = stage.write(wanted.join(classes.select("cls", "rep"), "cls"), f"{name}-wanted")
        own = docs.join(bounded(wanted), docs.doc_id == wanted.rep).select("cls", "text").mapInArrow(lambda it: _own_text(it, size), "cls long, text string")
        own = stage.write(own.groupBy("cls").agg(F.first("text").alias("text")), f"{name}-texts")
        side = lambda s: own.select(F.col("cls").alias(s), F.col("text").alias(f"t_{s}"))
        both = likely.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")
        return stage.write(both.mapInArrow(lambda it: _verified(it, size, num, den), "a long, b long"), f"{name}-links")

    # at any shingle that two sets share: at most those before it in both, itself, and those after it in both
    own, there = (n("at"), pos("at")), (n("hub_at"), pos("hub_at"))
    most = F.least(own[1], there[1]) + F.least(own[0] - own[1], there[0] - there[1])
    ends = live.filter("cls <> hub").filter(most * (num + den) >= (own[0] + there[0]) * num).select("cls", F.col("hub").alias("end"))
    first = verify(ends.select(F.least("cls", "end").alias("a"), F.greatest("cls", "end").alias("b")).distinct(), "first")
    labels = connected_components(first, stage, "first-cc")
    named = live.drop("hub", "hub_at").join(labels, live.cls == labels.v, "left").select("tok", "cls", "at", F.coalesce("component", "cls").alias("c"))
    named = stage.write(named, "named")
    stage.drop("live")
    apart = F.lit(True) if links else F.col("c_a") != F.col("c_b")
    several = named.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("tok")
    open_ = stage.write(named if links else named.join(several, "tok"), "open")
    stage.drop("named")
    x = open_.select("tok", *(F.col(k).alias(f"{k}_a") for k in ("cls", "c")), n("at").alias("n_a"), pos("at").alias("pos_a"))
    y = open_.select(F.col("tok").alias("tok_b"), *(F.col(k).alias(f"{k}_b") for k in ("cls", "c")), n("at").alias("n_b"), pos("at").alias("pos_b"))
    need = (F.col("n_a") + F.col("n_b")) * num  # of (num + den) times the intersection
    most = 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    across = x.join(y, (F.col("tok") == F.col("tok_b")) & (F.col("cls_a") < F.col("cls_b")) & apart & lengths & (most * (num + den) >= need))
    across = across.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
    tried = spark.read.schema("a long, b long").parquet(stage.path("first-likely"))
    second = verify(across.join(tried, ["a", "b"], "left_anti"), "second")
    labels = connected_components(first.union(second), stage, "cc")

    placed = classes.join(labels, classes.cls == labels.v, "left").select("cls", "rep", F.coalesce("component", "cls").alias("c"))
    smallest = placed.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_class = stage.write(placed.join(smallest, "c").select("cls", "component_id"), "components")
    more = []
    if links:
        by_class = by_class.join(_link_counts(rows, first.union(second)), "cls")
        more = [F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")]
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(by_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *more)


def _link_counts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, n_links) of every class: its other members and all those of the classes linked with it."""
    sizes = rows.filter("cls is not null and doc_id is not null").select("cls", "doc_id").distinct().groupBy("cls").agg(F.count("*").alias("m"))
    both = links.select("a", "b").union(links.select("b", "a"))
    near = both.join(sizes, both.b == sizes.cls).groupBy("a").agg(F.sum("m").alias("others"))
    return sizes.join(near, sizes.cls == near.a, "left").select("cls", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM words WHERE len(w) >= 4
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 3
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, sides.b FROM reach JOIN sides ON reach.r = sides.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON d.doc_id = c.v
"""
