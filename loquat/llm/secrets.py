"""Secret scans: candidates in every text, told apart by who owns them across the corpus.

Three kinds of candidates always count (``assign``, ``access``, ``hex``, see ``BASE``). A fourth, ``word``, is any long run
of key characters. The value of each candidate is hashed, and the hashes are aggregated over the whole corpus by distinct
owners and distinct repositories. A value that ``WIDE`` owners have is an example that was copied around; one that few
have, and that looks as if it were drawn at random, is live. So each span gets a verdict:

* ``example``: it names itself one (``PLACEHOLDER``),
* ``copied``: at least ``WIDE`` owners have its value,
* ``live``: its value looks random (``DISTINCT`` different characters, letters and ``DIGITS`` digits),
* ``weak``: what is left.

Base spans stay whatever their verdict. A word is added to them if it is live and either has an issuer's prefix, or mixes
cases and digits, or stands as the value of a base span anywhere in the corpus; words that overlap a base span are not.

All of it is Column expressions and joins. Matches are placed by running sums over the gaps between them (``_placed``). The
one pass over the texts writes rows of spans only (no text); ownership is counted on distinct (value, owner, repository),
which each task combines first, so a value in a third of all documents is one row a task and owner; its counts come back
by a join whose smaller side is broadcast if counted to be small and whose hot keys Spark splits otherwise.

Defined cases: null text is empty, and texts without a candidate have zeros and empty lists; null owners or repositories
count as one of that name; rows that repeat, or have no id, are judged each by itself (their copies count as one
owner's); a text of any length is scanned whole; ties of start are in the order of the kinds; an empty table gives no row;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loquat.functions.bind import let

from .common import Stage, bounded, table

# The patterns of base spans. Alone of its kind, a match of ``assign`` is measured by its second group.
_VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({_VALUE}+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGNED = 6
#: Runs of key characters.
WORD = rf"(?<!{_VALUE}){_VALUE}{{15,}}[A-Za-z0-9+/_=-]"
KINDS = ("assign", "access", "hex", "word")
BASE = KINDS[:3]
# What issuers begin their keys with, and what marks an example.
ISSUED = r"^(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29\.|eyJ)"
PLACEHOLDER = "example|sample|dummy|placeholder|change_?me|your|xxxx|1234567|abcdefg|00000000"
DIGITS, DISTINCT = 3, 10
#: Owners from which on a value is one that was copied around.
WIDE = 3
_PART = 256


def _running(sizes: Column) -> Column:
    """The sum of what stands before each number; in parts, as arrays that grow one by one take time with the square."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _PART).cast("int")), lambda b: F.slice(sizes, b * _PART + 1, F.lit(_PART)))
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    none = F.array().cast("array<bigint>")

    def sums(values: Column, begin: Column) -> Column:
        return F.aggregate(values, state(begin, none), lambda acc, x: state(acc["at"] + x, F.array_append(acc["out"], acc["at"])), lambda acc: acc["out"])

    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda acc, x: acc + x))
    return let(parts, lambda p: F.flatten(F.zip_with(p, sums(totals, F.lit(0).cast("bigint")), sums)))


_SPAN = "array<struct<kind: int, start: bigint, end: bigint, value: string>>"


def _placed(text: Column, kind: int, pattern: str, group: int) -> Column:
    """array<struct<kind, start, end, value>> of all matches, by code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).cast("bigint").alias("gap"), F.coalesce(F.length(m), F.lit(0)).cast("bigint").alias("size")))
    steps = F.arrays_zip(steps.alias("s"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

    def spans(found: Column) -> Column:
        before = _running(F.transform(found, lambda x: x["s"]["gap"] + x["s"]["size"]))
        made = F.zip_with(found, before, lambda x, at: F.struct(F.lit(kind).alias("kind"), (at + x["s"]["gap"]).alias("start"), (at + x["s"]["gap"] + x["s"]["size"]).alias("end"), x["v"].alias("value")))
        return F.filter(made, lambda x: x["value"].isNotNull())  # the last gap has no match

    return F.when(text.rlike(pattern), let(steps, spans)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _spans(text: Column) -> Column:
    assigned = F.filter(_placed(text, 0, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGNED)
    return F.concat(assigned, *(_placed(text, k, p, 0) for k, p in ((1, ACCESS), (2, HEX), (3, WORD))))


def _count(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, ""))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, wide: int = WIDE) -> DataFrame:
    """One row per row: id, spans array<struct<start, kind, end, base, owners, repositories, verdict>>, in order.

    ``repository`` and ``owner`` say whose a row is; without an owner each repository is its own, without both each
    document.
    """
    stage = Stage(docs.sparkSession, "secrets")
    key = F.col(f"`{id_col}`")
    repository = key if repository is None else repository
    owner = repository if owner is None else owner
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("id"), name(owner).alias("owner"), name(repository).alias("repository"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("row", "id", "owner", "repository", _spans(F.col("text")).alias("spans"))
    value = lambda x: x["value"]
    shape = F.transform(
        "spans",
        lambda x: F.struct(
            *(x[c] for c in ("kind", "start", "end")),
            F.sha2(value(x).cast("binary"), 256).alias("key"),
            value(x).rlike(f"(?i){PLACEHOLDER}").alias("example"),
            ((_count(value(x), "[^0-9]") >= DIGITS) & value(x).rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value(x), ""))) >= DISTINCT)).alias("random"),
            (value(x).rlike(ISSUED) | (value(x).rlike("[A-Z]") & value(x).rlike("[a-z]") & ~value(x).contains("."))).alias("issued"),
        ),
    )
    rows = stage.write(rows.select("row", "id", "owner", "repository", shape.alias("spans")), "found")
    found = rows.select("row", "owner", "repository", F.explode("spans").alias("x")).select("row", "owner", "repository", "x.*")

    owned = found.groupBy("key", "owner", "repository").agg(F.max(F.col("kind") < len(BASE)).alias("credential"))
    owned = owned.groupBy("key", "owner").agg(F.count("*").alias("repositories"), F.max("credential").alias("credential"))
    owned = owned.groupBy("key").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("credential").alias("credential"))
    owned = stage.write(owned, "owned")

    judged = found.drop("owner", "repository").join(bounded(owned), "key").drop("key")
    verdict = F.when(F.col("example"), "example").when(F.col("owners") >= wide, "copied").when(F.col("random"), "live").otherwise("weak")
    base = F.col("kind") < len(BASE)
    judged = judged.select("*", verdict.alias("verdict"), base.alias("base"))
    judged = judged.filter(base | ((F.col("verdict") == "live") & (F.col("issued") | F.col("credential"))))
    near = W.partitionBy("row").orderBy("start")
    before = F.max(F.when(base, F.col("end"))).over(near.rangeBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(near.rangeBetween(1, W.unboundedFollowing))
    clear = (F.coalesce(before, F.col("start")) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    judged = judged.withColumn("clear", clear).filter(F.col("base") | F.col("clear"))
    one = F.struct("start", "kind", "end", "base", "owners", "repositories", "verdict")
    listed = judged.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    named = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), *(x[c].alias(c) for c in ("end", "base", "owners", "repositories", "verdict"))))
    empty = F.array().cast("array<struct<start: bigint, kind: string, end: bigint, base: boolean, owners: bigint, repositories: bigint, verdict: string>>")
    out = rows.select("row", "id").join(listed.select("row", named.alias("spans")), "row", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))


def said(spans: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are the sources, repositories a source's documents of one language."""
    docs = table(spark, sf_dir, "documents")
    out = scan_secrets(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    of = lambda field, value: F.size(F.filter("spans", lambda x: x[field] == value)).cast("long").alias(f"n_{value}")
    kinds = [of("kind", k) for k in BASE]
    verdicts = [of("verdict", v) for v in ("live", "copied")]
    return out.select("doc_id", *kinds, F.sha2(said(F.filter("spans", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), *verdicts)


def _either(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SQL_ASSIGN = rf"""({_either("password|passwd|secret|token|api_?key")})["'']?\x20*[:=]\x20*["'']?({_VALUE}+)"""


def _sql_hits(kind: int, pattern: str, group: int) -> str:
    return f"""select r, owner, repository, {kind} as kind, string_split_regex(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as ms, regexp_extract_all(text, '{pattern}', {group}) as vs from d"""


SQL = rf"""
with d as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, concat_ws('/', source, lang) as repository from documents
), hits as (
    {_sql_hits(0, _SQL_ASSIGN, 2)} union all {_sql_hits(1, ACCESS, 0)} union all {_sql_hits(2, HEX, 0)} union all {_sql_hits(3, f"{_VALUE}+", 0)}
), each_hit as (
    select r, owner, repository, kind, i, gaps[i] as gap, ms[i] as m, vs[i] as v from hits, unnest(range(1, len(ms) + 1)) as t(i)
), placed as (
    select *, sum(length(gap) + length(m)) over (partition by r, kind order by i) as till from each_hit
), cut as (  -- a word doesn't end with a dot
    select r, owner, repository, kind, till - length(m) as start, case when kind = 3 then rtrim(v, '.') else v end as v, till - case when kind = 3 then length(v) - length(rtrim(v, '.')) else 0 end as till from placed
), x as (
    select *, kind < 3 as base, regexp_matches(lower(v), '{PLACEHOLDER}') as example,
        length(regexp_replace(v, '[^0-9]', '', 'g')) >= {DIGITS} and regexp_matches(v, '[A-Za-z]') and len(list_distinct(string_split(v, ''))) >= {DISTINCT} as random,
        regexp_matches(v, '{ISSUED}') or (regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and not contains(v, '.')) as issued
    from cut where case kind when 0 then length(v) >= {ASSIGNED} when 3 then length(v) >= 16 else true end
), owned as (
    select v, count(distinct owner) as owners, max(base) as credential from x group by v
), judged as (
    select x.*, credential, case when example then 'example' when owners >= {WIDE} then 'copied' when random then 'live' else 'weak' end as verdict from x join owned using (v)
), kept as (
    select * from judged j where base or (verdict = 'live' and (issued or credential) and not exists (select 1 from x b where b.base and b.r = j.r and b.start < j.till and j.start < b.till))
), told as (
    select *, concat_ws(':', ['assign', 'access', 'hex', 'word'][kind + 1], start::bigint, till::bigint) as said from kept
), listed as (
    select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, coalesce(string_agg(said, ',' order by start, kind) filter (base), '') as base,
        string_agg(said, ',' order by start, kind) as spans, count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'copied') as n_copied
    from told group by r
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256,
    coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_copied, 0)::bigint as n_copied
from d left join listed using (r)
"""
