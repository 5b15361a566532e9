"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of its hits.

A list names canonical URLs, which are blocked. Rules ``host/path`` fit their host and all subdomains where the URL's
path starts with the rule's path; of several the longest wins (then the longer host, then the greater text), and a rule
wins over the list. A canonical URL has no scheme, user, fragment, default port, ``index.html`` or slash at its end; its
host is in lower case without the dot at its end, and its parameters are sorted, without those of ``TRACKING``.

Each URL has as possible keys itself, and its host's parents times the *lengths* of rule paths in use. A key is
hashed to one block of 512 bits, in which eight bits are tested: the filter is a table of blocks, built by Spark with
``BITS_A_KEY`` bits for each listed key whatever their number, and joined by block (broadcast if counted to be
small). Hits, on distinct URLs, are joined with the list on the exact key, which removes false positives. URLs
without a host meet nothing.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule; URLs without a rule that
aren't listed get ``default``; rows that repeat, or have no id, are each judged; very long URLs and paths work like
others; an empty list, no rules, or an empty table too; columns ``host``, ``path``, ``rule`` and ``verdict`` of the
caller are replaced by the result's, others passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, bounded, table

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
WORDS = 8  # of 64 bits in a block
BITS_A_KEY = 16
#: The query lists the canonical URL of each page whose id is divisible by this, so that its list grows with the pages.
LISTED_EACH = 7
# Parameters that don't name a page.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """The form by which a URL is listed; '' without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), r"\.?(:(80|443)?)?$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), "/+$", "")
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    named = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    sorted_ = F.array_join(F.array_sort(named), "&")
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, path, F.when(sorted_ == "", F.lit("")).otherwise(F.concat(F.lit("?"), sorted_))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


class BlockedBloom:
    """A table (block, words: array of eight longs) of the blocks that hold a key."""

    def __init__(self, keys: DataFrame, column: str, count: int, stage: Stage):
        self.blocks = max(1, -(-count * BITS_A_KEY // (64 * WORDS)))
        word = lambda k: F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key, {k}), 64) as int))"))
        table = keys.select(F.col(column).alias("key")).groupBy(_block(F.col("key"), self.blocks).alias("block")).agg(F.array(*(word(k) for k in range(WORDS))).alias("words"))
        self.table = stage.write(table, "bloom")

    def possible(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose ``key`` the filter may hold."""
        names = rows.columns
        found = rows.withColumn("_block", _block(F.col(key), self.blocks)).join(bounded(self.table.select(F.col("block").alias("_block"), F.col("words").alias("_words"))), "_block")
        for k in range(WORDS):
            found = found.filter(F.getbit(F.get("_words", F.lit(k)), F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(64)).cast("int")) == 1)
        return found.select(*names)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", listed: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has (rule, verdict), ``listed`` (url), canonical."""
    spark = pages.sparkSession
    stage = Stage(spark, "urls")
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_col}`")
    known = rules.filter("rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    known = known.withColumn("rule_host", F.substring_index("rule", "/", 1)).select("rule", "verdict", F.length("rule_host").alias("h"), F.expr("length(rule) - length(rule_host)").alias("n"), F.concat(F.lit("rule "), "rule").alias("key"))
    if listed is not None:
        urls = listed.select("url").filter("url <> ''").distinct()
        known = known.unionByName(urls.select(F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(-1).alias("h"), F.lit(-1).alias("n"), F.concat(F.lit("url "), "url").alias("key")))
    known = stage.write(known, "known")
    lengths = sorted(r.n for r in known.filter("rule is not null").select("n").distinct().collect())  # at most the length of a URL
    bloom = BlockedBloom(known, "key", known.count(), stage)
    parsed = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    places = parsed.select("_url", "host", "path").filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)).cast("array<string>"), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.concat(F.lit("rule "), h, p))))
    if listed is not None:
        keys = F.array_append(keys, F.concat(F.lit("url "), canonical(F.col("_url"))))
    hits = bloom.possible(places.select("_url", F.explode(F.array_distinct(keys)).alias("key")), "key")
    exact = hits.join(bounded(known), "key")
    best = exact.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("l"), "h", "rule", "verdict")).alias("best"))
    best = stage.write(best.select("_url", "best.rule", "best.verdict"), "best")
    judged = parsed.filter("host <> ''").join(bounded(best), "_url", "left")
    rest = parsed.filter("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    columns = ["_row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")]
    out = judged.select(*columns).unionByName(rest.select(*columns))
    return out.select("_row.*", "host", "path", "rule", "verdict")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list, (url): other pages, with or without an id of that kind, may have the same canonical URL."""
    return pages.filter(F.col("page_id") % LISTED_EACH == 0).select(canonical(F.col("url")).alias("url")).filter("url <> ''")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules, listed=listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
parsed AS (
  SELECT page_id, url, strpos(url, '://') AS mark, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest,
         string_split(string_split(rest, '#')[1], '?')[1] AS place, strpos(place, '/') AS slash,
         CASE WHEN slash > 0 THEN substr(place, slash) ELSE '' END AS path,
         translate(CASE WHEN slash > 0 THEN substr(place, 1, slash - 1) ELSE place END, '{_UPPER}', '{_LOWER}') AS host,
         string_split(string_split(rest, '#')[1], '?')[2:] AS asked FROM pages
), parts AS (
  SELECT *, regexp_replace(CASE WHEN strpos(host, '@') > 0 THEN string_split(host, '@')[-1] ELSE host END, '[.]?(:|:80|:443)?$', '') AS bare,
         rtrim(regexp_replace(path, '/index[.]html?$', '/'), '/') AS page,
         list_sort(list_filter(string_split(array_to_string(asked, '?'), '&'), lambda p: p <> '' AND NOT list_contains({TRACKING}, string_split(p, '=')[1]))) AS named FROM parsed
), form AS (
  SELECT *, bare || page || CASE WHEN len(named) > 0 THEN '?' || array_to_string(named, '&') ELSE '' END AS canonical FROM parts
), listed AS (
  SELECT DISTINCT canonical AS url FROM form WHERE page_id % {LISTED_EACH} = 0 AND bare <> ''
), fits AS (
  SELECT url, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM form) f JOIN (SELECT *, string_split(rule, '/')[1] AS h FROM rules) r
    ON (host = h OR host LIKE '%.' || h) AND starts_with(path, substr(r.rule, length(h) + 1)) GROUP BY url
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, f.rule,
       coalesce(f.verdict, CASE WHEN bare <> '' AND l.url IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM form LEFT JOIN fits f ON form.url = f.url LEFT JOIN listed l ON canonical = l.url
"""
