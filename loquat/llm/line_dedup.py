"""Line dedup [native]: a log-template tree; templates that recur across documents are dropped.

Everything here is DataFrame operations. A line's words go down a tree of fixed depth: their number, then the
first ``DEPTH`` words, a word with a digit counting as a variable field. Within a leaf a word is constant at its
place if it stands there in at least ``DOCS`` distinct lines (counted once a document); other places are variable
fields as well. A line with its variable fields replaced is its template, if ``SHARE`` of its words are constant
(digits count as one word) and ``PLAIN`` of them are words without digits.

A template recurs if it is in enough documents (``DOCS``; more for short lines, below), and
* after at least half as many different lines and before at least half as many (lines of one leaf are the same; the ends
  of documents are all different), or
* the maximal runs of such lines that it stands in have that many different surroundings (the lines above and below the
  run; lines without words don't count), in documents of which these lines are at most half the words.
So boilerplate in unrelated documents goes, of one line or of several, while the lines of documents that are copies of
each other stay: whole copies are another operator's task, and they neither add to nor take from what unrelated
documents show. Equal texts count as one document.

A line of fewer than ``WORDS`` words has all its words in its leaf, so only digits vary, and it must be in ``DOCS`` more
documents for each word that it has less: short lines are the likelier to be alike by chance. Leaves that cannot recur
leave before any word is exploded.

Defined cases: null text stays null and has no lines; an empty text is one empty line; lines without words stay; rows
that repeat, or repeat an id, or have none, are each kept with their lines judged alike; ids are of any type; a document
may lose all its lines and then has an empty text; a very long text is one row's work where its lines are cut, and a very
long line is one row; an empty table gives no row; other columns are passed on, whatever their names, but for ``n_lines``
and ``n_dropped``, which the result's replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, bounded, table

WORDS = 5
DEPTH = 3
DOCS = 5
SHARE, PLAIN = 0.8, 0.5
FIELD = "<*>"
_WORDS = r"[^ \t\r\f\v]+"


def _masked(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), F.lit(FIELD)).otherwise(word)


def _words(line: Column) -> Column:
    """Words between blanks; an empty line has none."""
    return F.filter(F.split(line, r"[ \t\r\f\x0b]+"), lambda w: w != "")


def _leaf(line: Column) -> Column:
    """(leaf: of a line with words; near: what the line is to its neighbours; size: its words)."""
    first = lambda w: F.slice(w, 1, F.when(F.size(w) < WORDS, F.lit(WORDS)).otherwise(F.lit(DEPTH)))
    bound = F.transform(F.array(_words(line)), lambda w: F.struct(F.size(w).cast("long").alias("size"), F.when(F.size(w) > 0, F.xxhash64(F.size(w), F.transform(first(w), _masked))).alias("leaf")))
    return F.element_at(F.transform(bound, lambda x: F.struct(x["leaf"].alias("leaf"), F.coalesce(x["leaf"], F.xxhash64(line)).alias("near"), x["size"].alias("size"))), 1)


def _needed(size: Column) -> Column:
    """Documents that a template of so many words must be in."""
    return F.greatest(F.lit(DOCS), DOCS * (1 + WORDS - size))


def _recurring_runs(seen: DataFrame, frequent: DataFrame) -> DataFrame:
    """Templates of ``frequent`` (staged) whose runs have enough different surroundings in documents that aren't mostly such lines."""
    held = seen.join(bounded(frequent), "template", "left_semi")
    order, own = Window.partitionBy("_digest").orderBy("rank"), Window.partitionBy("_digest", "run")
    held = held.withColumn("run", F.col("rank") - F.row_number().over(order)).withColumn("shared", F.sum("size").over(Window.partitionBy("_digest")))
    edges = F.xxhash64(F.min_by("over", "rank").over(own), F.max_by("under", "rank").over(own))
    held = held.withColumn("edges", edges).filter("2 * shared <= total").select("template", "size", "edges").distinct()
    return held.groupBy("template").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter(F.col("n") >= _needed(F.col("size"))).select("template")


def dropped_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_row: the row of ``docs``, _kept: its text without the lines that go, n_lines, n_dropped)."""
    spark = docs.sparkSession
    stage = Stage(spark, "lines")
    docs = docs.select(F.struct("*").alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    rows = docs.select(F.xxhash64("_text").alias("_digest"), F.split("_text", "\n").alias("_lines")).filter("_lines is not null")
    leaves = F.transform("_lines", _leaf)
    # a leaf can recur only if several documents have it
    each = rows.select("_digest", F.explode(leaves).alias("x")).select("_digest", "x.leaf").filter("leaf is not null")
    common = each.groupBy("leaf").agg(F.count("*").alias("n"), F.min("_digest").alias("a"), F.max("_digest").alias("b")).filter(f"n >= {DOCS} and a <> b")
    common = stage.write(common.select("leaf"), "leaves")

    # lines with words: their place, and what stands above and below, of all lines and of those with words
    numbered = F.transform("leaves", lambda leaf, k: F.struct(k.alias("at"), leaf["leaf"].alias("leaf"), leaf["near"].alias("near"), leaf["size"].alias("size")))
    placed = rows.withColumn("leaves", leaves).withColumn("solid", F.filter(numbered, lambda x: x["size"] > 0))
    placed = placed.withColumn("total", F.aggregate("solid", F.lit(0).cast("long"), lambda n, x: n + x["size"]))
    close = lambda k: F.coalesce(F.get("leaves", k)["near"], "_digest")
    beside = lambda k: F.coalesce(F.get("solid", k)["near"], F.lit(0).cast("long"))
    around = F.transform(
        "solid",
        lambda x, k: F.struct(x["at"].alias("at"), x["leaf"].alias("leaf"), x["size"].alias("size"), close(x["at"] - 1).alias("above"), close(x["at"] + 1).alias("below"), F.get("_lines", x["at"]).alias("line"), k.alias("rank"), beside(k - 1).alias("over"), beside(k + 1).alias("under")),
    )
    lines = placed.select("_digest", "total", F.explode(around).alias("x")).select("_digest", "total", "x.*")
    lines = lines.join(bounded(common), "leaf", "left_semi").withColumn("words", F.transform(_words(F.col("line")), _masked)).drop("line")
    lines = stage.write(lines.withColumn("form", F.xxhash64("words")), "lines")

    forms = lines.groupBy("leaf", "form").agg(F.first("words").alias("words"), F.countDistinct("_digest").alias("docs"))
    forms = stage.write(forms, "forms")
    words = forms.select("leaf", "form", "docs", F.posexplode("words").alias("place", "word"))
    constant = words.groupBy("leaf", "place", "word").agg(F.sum("docs").alias("support")).filter(F.col("support") >= DOCS).select("leaf", "place", "word", F.lit(True).alias("constant"))
    constant = stage.write(constant, "constant")
    shaped = words.join(bounded(constant), ["leaf", "place", "word"], "left").groupBy("leaf", "form").agg(
        F.avg(F.when(F.col("constant"), 1.0).otherwise(0.0)).alias("share"),
        F.avg(F.when(F.col("constant") & (F.col("word") != FIELD), 1.0).otherwise(0.0)).alias("plain"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("word")).otherwise(FIELD).alias("w")))), lambda x: x["w"]).alias("template"),
    )
    shaped = stage.write(shaped.filter((F.col("share") >= SHARE) & (F.col("plain") >= PLAIN)).select("leaf", "form", F.xxhash64("leaf", "template").alias("template")), "templates")

    seen = lines.select("leaf", "form", "_digest", "above", "below", "rank", "over", "under", "size", "total").distinct()
    seen = stage.write(seen.join(bounded(shaped), ["leaf", "form"]), "seen")
    different = lambda c: seen.select("template", "size", c).distinct().groupBy("template", "size").agg(F.count("*").alias(c))
    frequent = stage.write(different("_digest").filter(F.col("_digest") >= _needed(F.col("size"))), "frequent")
    counted = frequent.join(different("above").drop("size"), "template").join(different("below").drop("size"), "template")
    recurring = counted.filter("2 * above >= _digest and 2 * below >= _digest").select("template")
    recurring = recurring.unionByName(_recurring_runs(seen, frequent.select("template"))).distinct()
    gone = stage.write(shaped.join(recurring, "template", "left_semi").select("leaf", "form"), "gone")

    dropped = lines.join(bounded(gone), ["leaf", "form"], "left_semi").groupBy("_digest").agg(F.collect_set("at").alias("_gone"))
    dropped = stage.write(dropped.select(F.col("_digest").alias("_gone_digest"), "_gone"), "dropped")
    stage.drop("leaves", "lines", "forms", "constant", "templates", "seen", "frequent", "gone")
    split = F.split("_text", "\n")
    kept = F.array_join(F.filter(split, lambda line, k: ~F.array_contains("_gone", k)), "\n")
    out = docs.join(dropped.hint("merge"), F.xxhash64("_text") == F.col("_gone_digest"), "left")  # lists of lines have no bound: never broadcast
    return out.select(
        "_row",
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias("_kept"),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_templates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the text of the lines that stay, and n_lines and n_dropped (long)."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    of = lambda c: F.col("_kept").alias(c) if c == text_col else F.col(f"_row.`{c}`")
    return dropped_lines(docs, text_col).select(*(of(c) for c in names), "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT doc_id, text, k, line, list_filter(string_split_regex(line, '[ \\t\\r\\f\\x0b]+'), lambda w: w <> '') AS raw FROM lines
), masked AS (
  SELECT doc_id, text, k, line, list_transform(raw, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{FIELD}' ELSE w END) AS words FROM words
), leaves AS (
  SELECT *, len(words) AS size, CASE WHEN len(words) >= {WORDS} THEN len(words)::VARCHAR || ' ' || array_to_string(words[1:{DEPTH}], ' ')
    WHEN len(words) > 0 THEN len(words)::VARCHAR || ' ' || array_to_string(words, ' ') END AS leaf FROM masked
), near AS (
  SELECT *, coalesce('l' || leaf, 't' || line) AS near FROM leaves
), placed AS (
  SELECT *, coalesce(lag(near) OVER w, text) AS above, coalesce(lead(near) OVER w, text) AS below FROM near WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), forms AS (
  SELECT leaf, words, count(DISTINCT text) AS docs FROM placed WHERE leaf IS NOT NULL GROUP BY leaf, words
), places AS (
  SELECT leaf, words, docs, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM forms
), constant AS (
  SELECT leaf, place, word FROM places GROUP BY leaf, place, word HAVING sum(docs) >= {DOCS}
), shaped AS (
  SELECT p.leaf, p.words, list(CASE WHEN c.word IS NULL THEN '{FIELD}' ELSE p.word END ORDER BY p.place) AS template
  FROM places p LEFT JOIN constant c ON p.leaf = c.leaf AND p.place = c.place AND p.word = c.word
  GROUP BY p.leaf, p.words HAVING avg(CASE WHEN c.word IS NULL THEN 0.0 ELSE 1.0 END) >= {SHARE}
     AND avg(CASE WHEN c.word IS NULL OR c.word = '{FIELD}' THEN 0.0 ELSE 1.0 END) >= {PLAIN}
), seen AS (
  SELECT s.leaf, s.template, l.doc_id, l.text, l.k, l.size, l.above, l.below, greatest({DOCS}, {DOCS} * (1 + {WORDS} - l.size)) AS need
  FROM placed l JOIN shaped s ON l.leaf = s.leaf AND l.words = s.words
), frequent AS (
  SELECT leaf, template FROM seen GROUP BY leaf, template HAVING count(DISTINCT text) >= max(need)
), solid AS (
  SELECT doc_id, k, row_number() OVER w AS rank, coalesce(lag(near) OVER w, '') AS over_, coalesce(lead(near) OVER w, '') AS under_, sum(size) OVER (PARTITION BY doc_id) AS total
  FROM placed WHERE size > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), held AS (
  SELECT e.leaf, e.template, e.doc_id, e.need, o.rank, o.over_, o.under_, o.total, sum(e.size) OVER (PARTITION BY e.doc_id) AS shared,
         o.rank - row_number() OVER (PARTITION BY e.doc_id ORDER BY o.rank) AS run
  FROM seen e JOIN frequent f ON e.leaf = f.leaf AND e.template = f.template JOIN solid o ON e.doc_id = o.doc_id AND e.k = o.k
), edges AS (
  SELECT leaf, template, need, first_value(over_) OVER (PARTITION BY doc_id, run ORDER BY rank) AS head, first_value(under_) OVER (PARTITION BY doc_id, run ORDER BY rank DESC) AS tail
  FROM held WHERE 2 * shared <= total
), recurring AS (
  SELECT leaf, template FROM seen JOIN frequent USING (leaf, template)
  GROUP BY leaf, template HAVING 2 * count(DISTINCT above) >= count(DISTINCT text) AND 2 * count(DISTINCT below) >= count(DISTINCT text)
  UNION SELECT leaf, template FROM (SELECT DISTINCT * FROM edges) GROUP BY leaf, template HAVING count(*) >= max(need)
), gone AS (
  SELECT s.leaf, s.words FROM shaped s JOIN recurring r ON s.leaf = r.leaf AND s.template = r.template
), judged AS (
  SELECT l.doc_id, l.k, l.line, g.leaf IS NOT NULL AS dropped FROM placed l LEFT JOIN gone g ON l.leaf = g.leaf AND l.words = g.words
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '') AS text FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
