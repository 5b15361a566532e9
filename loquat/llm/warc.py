"""WARC: written with revisits for equal payloads, and read back by boundary-chain verification.

Writing: one record a row. Of records whose payloads are equal and have at least ``least`` bytes, that with the
smallest id is a response and the others are revisits that refer to it and carry no payload. A record ends with
two line ends, which the text writer adds, so the archive is written by the executors from whole rows.

Reading: files are split wherever Spark splits them. The reader cuts at the record magic, so a task gives, for
each place with the magic, a candidate record: where it starts and, from its own header, where its successor must
start. The magic may also stand inside a payload. Offsets follow from the lengths of the pieces within their split, and
from the lengths of the splits before it; so a file of any size is work for as many tasks as it has splits. Candidates
of a split that follow one another are contracted to runs, and pointer jumping over the runs of all splits (the reach
doubles each round), from the start of each file, keeps the records that the chain reaches. Payloads that hold the
magic are put together from their pieces; only files with such payloads are read again for that.

Defined cases: a null payload is empty; a null id is written empty and read as null, never referred to, and the
row revisits an equal payload if a row with an id has it; rows that repeat a smallest id are all responses; line
ends in a URL are written as %0D and %0A; other header fields of a record, and files without records, are no
error; a very long payload is one row's work; columns other than id, URL and payload are ignored, whatever their names;
ids are whole numbers; an empty table writes an archive without records. A truncated last record is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, bounded, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST = 100


def _payload_digest(payload: Column) -> Column:
    return F.sha2(F.encode(payload, "utf-8"), 256)


def write_archive(rows: DataFrame, path: str, stage: Stage, id_col: str, url_col: str, payload_col: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row to the folder ``path``."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": _payload_digest(F.col("payload"))})
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    first = stage.write(first.select("digest", "first"), "first")
    # small payloads, of which any number may be equal, get keys that meet nothing and spread
    key = F.when(F.col("bytes") >= least, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("small"), "id", "url"))
    joined = rows.withColumn("key", key).join(bounded(first.withColumnRenamed("digest", "key")), "key", "left")
    refers = F.when(F.col("first").isNotNull() & (F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    revisit = refers.isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    sent = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">")))).otherwise(""),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("text/html")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(END),
        sent,
    )
    joined.select(record.alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """What follows each magic up to the next: (file, block, place, value)."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    read = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    return read if files is None else read.join(bounded(files), "file", "left_semi")


def _offsets(pieces: DataFrame) -> DataFrame:
    """With the byte at which the magic of each piece stands (before the first magic of a file: -1 or less)."""
    length = F.col("size") + len(MAGIC)
    splits = pieces.groupBy("file", "block").agg(F.sum(length).alias("total"))
    before = F.sum("total").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))  # a row for each split
    splits = splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum(length).over(W.partitionBy("file", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    placed = pieces.withColumn("within", F.coalesce(within, F.lit(0))).join(splits, ["file", "block"])
    return placed.withColumn("start", F.col("base") + F.col("within") - len(MAGIC)).drop("place", "base", "within")


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def reachable(candidates: DataFrame, stage: Stage) -> DataFrame:
    """Of candidates (file, block, start, succ, ...) those that the chain from the start of their file reaches."""
    by_start = W.partitionBy("file", "block").orderBy("start")
    order = candidates.withColumns({"follows": F.coalesce(F.lag("succ").over(by_start) == F.col("start"), F.lit(False)), "next": F.lead("start").over(by_start)})
    order = stage.write(order, "candidates")
    # where a chain goes on elsewhere than with the next candidate of the split, a run begins
    jumps = stage.write(order.filter("next is null or succ <> next").select("file", F.col("succ").alias("start")).distinct(), "jumps")
    heads = order.join(bounded(jumps.withColumn("target", F.lit(True))), ["file", "start"], "left").withColumn("head", F.when(~F.col("follows") | F.col("target").isNotNull(), F.col("start")))
    runs = heads.withColumn("run", F.last("head", ignorenulls=True).over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    runs = stage.write(runs.drop("follows", "next", "target", "head"), "runs")
    # a run is named by its start; ``next`` is the run at which it ends, if there is one
    graph = runs.groupBy("file", "run").agg(F.max_by("succ", "start").alias("succ"))
    ends = graph.select("file", F.col("run").alias("succ"), F.col("run").alias("next"))
    graph = stage.write(graph.join(ends, ["file", "succ"], "left").select("file", "run", "next", (F.col("run") == 0).alias("reached")), "graph-0")
    k = 0
    while True:
        marked = graph.filter("reached and next is not null").select("file", F.col("next").alias("run")).distinct().withColumn("marked", F.lit(True))
        if not marked.join(graph.filter("not reached"), ["file", "run"], "left_semi").limit(1).count():
            break
        beyond = graph.select("file", F.col("run").alias("next"), F.col("next").alias("beyond"))
        after = graph.join(marked, ["file", "run"], "left").join(beyond, ["file", "next"], "left")
        k += 1
        graph = stage.write(after.select("file", "run", F.col("beyond").alias("next"), (F.col("reached") | F.col("marked").isNotNull()).alias("reached")), f"graph-{k}")
        stage.drop(f"graph-{k - 1}")
    reached = graph.filter("reached").select("file", "run")
    return runs.join(bounded(reached), ["file", "run"], "left_semi").drop("run")


def read_archive(spark: SparkSession, path: str, stage: Stage) -> DataFrame:
    """One row per record: file, start, id, type, url, refers_to, stated_digest, stated_bytes, bytes, digest (of what the record holds)."""
    pieces = _pieces(spark, path).withColumn("size", F.octet_length("value").cast("long"))
    header = F.substring_index("value", END, 1)
    pieces = pieces.withColumn("header", F.when(F.instr("value", END) > 0, header))
    length = _field(F.col("header"), "Content-Length").cast("long")
    pieces = pieces.withColumns({"at": F.octet_length("header") + len(END), "bytes": length})
    whole = F.col("size") == F.col("at") + F.col("bytes") + len(END)
    body = F.substring(F.col("value").cast("binary"), F.col("at") + 1, F.col("bytes").cast("int"))
    fields = {
        "type": _field(F.col("header"), "WARC-Type"),
        "id": F.regexp_extract(F.coalesce(_field(F.col("header"), "WARC-Record-ID"), F.lit("")), r"<urn:page:(-?\d+)>", 1),
        "refers": F.regexp_extract(F.coalesce(_field(F.col("header"), "WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1),
        "url": _field(F.col("header"), "WARC-Target-URI"),
        "stated_digest": F.regexp_extract(F.coalesce(_field(F.col("header"), "WARC-Payload-Digest"), F.lit("")), "sha256:([0-9a-f]{64})", 1),
        "stated_bytes": _field(F.col("header"), "X-Payload-Length").cast("long"),
    }
    parsed = pieces.withColumns(fields | {"digest": F.when(whole, F.sha2(body, 256))}).drop("value", "header")
    known = _offsets(parsed).filter("start >= 0")
    # a candidate whose header gives its length; the magic stands ``at`` + ``bytes`` + the end before its successor
    candidates = known.filter("bytes is not null and bytes >= 0").withColumn("succ", F.col("start") + len(MAGIC) + F.col("at") + F.col("bytes") + len(END))
    # a record that ends beyond its file is cut off
    ends = stage.write(known.groupBy("file").agg(F.max(F.col("start") + len(MAGIC) + F.col("size")).alias("end")), "ends")
    records = stage.write(reachable(candidates.join(bounded(ends), "file").filter("succ <= end").drop("end"), stage), "records")
    columns = ["file", "start", F.when(F.col("id") != "", F.col("id")).cast("long").alias("id"), "type", "url", F.when(F.col("refers") != "", F.col("refers")).cast("long").alias("refers_to"), "stated_digest", "stated_bytes", "bytes"]
    done = records.filter("digest is not null").select(*columns, "digest")
    spread = records.filter("digest is null")
    if not spread.limit(1).count():
        return done
    # payloads that hold the magic: their files are read again, with the text
    files = stage.write(spread.select("file").distinct(), "files")
    again = _pieces(spark, path, files).withColumn("size", F.octet_length("value").cast("long"))
    owner = records.select("file", F.col("start").alias("owner"))
    own = _offsets(again).filter("start >= 0").join(owner.withColumnRenamed("owner", "start").withColumn("owner", F.col("start")), ["file", "start"], "left")
    own = stage.write(own, "parts")
    # the record that a piece belongs to begins in its split, or is the last one to begin in the splits before
    splits = own.groupBy("file", "block").agg(F.max("owner").alias("last"))
    earlier = F.max("last").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("file", "block", earlier.alias("earlier"))
    own = own.withColumn("owner", F.last("owner", ignorenulls=True).over(W.partitionBy("file", "block").orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    own = own.join(splits, ["file", "block"]).withColumn("owner", F.coalesce("owner", "earlier")).drop("earlier")
    wanted = spread.select("file", F.col("start").alias("owner"))
    parts = own.join(wanted, ["file", "owner"], "left_semi")
    glued = parts.groupBy("file", F.col("owner").alias("start")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), MAGIC).alias("text"))
    whole = spread.join(glued, ["file", "start"]).withColumn("digest", F.sha2(F.substring(F.col("text").cast("binary"), F.col("at") + 1, F.col("bytes").cast("int")), 256))
    return done.unionByName(whole.select(*columns, "digest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), stage.path("archive"), stage, "page_id", "url", "html")
    records = read_archive(spark, stage.path("archive"), stage)
    revisit = F.col("type") == "revisit"
    return records.select(
        F.col("id").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


SQL = f"""
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
hashed AS (SELECT page_id, n, sha256(html) AS digest FROM sized),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM hashed)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST} AND page_id <> first THEN first END AS refers_to FROM firsts
"""
