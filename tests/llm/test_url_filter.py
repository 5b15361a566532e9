import duckdb

from loquat.llm import url_filter as U
from loquat.llm.common import Stage


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7", "https://example.com/en/8?x=/en/7", "http://myexample.com/en/7", "http://net/de/1", "http://xnet/de/1", "http://a.b.example.net/de/89#t", "http://example.net/de/7", "ftp://q.org/es/", "http://q.org/es", "http://com?en/", "//com/en/", "x://ÄÉ.com/en/ü", "http://user@h.com:80/en/1", "http://a.com/en/\nb", "a://b://com/en/", "http://" + "a." * 300 + "com/en/" + "y" * 5000]


def test_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://com/en/"), (4, URLS[4])]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, key int")
    rules = spark.createDataFrame(U.RULES, "rule string, verdict string")
    got = sorted(((str(r.page_id), r.url, r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, rules).collect()), key=str)
    assert got == sorted([(str(i), u, *plain(u, U.RULES)) for i, u in rows], key=str)


def test_bloom_never_misses_and_rarely_errs(spark):
    keys = spark.range(4000).selectExpr("concat('host', id, '/p') as key", "id as block", "id as words")
    bloom = U.BlockedBloom(keys, "key", 4000, Stage(spark, "bloom-test"))
    other = spark.range(4000).selectExpr("concat('other', id, '/p') as key")
    assert bloom.possible(keys, "key").count() == 4000
    assert bloom.possible(other, "key").count() < 200


def test_canonical_and_listed(spark):
    same = ["http://A.com:80/x/?b=2&a=1#t", "https://user@a.com./x?a=1&utm_source=q&b=2", "x://a.com/x/index.html?b=2&a=1"]
    other = ["http://a.com/x?a=1", "http://a.com/X?a=1&b=2", "http://b.a.com/x?a=1&b=2", "http://a.com:81/x?a=1&b=2"]
    rows = [(k, u) for k, u in enumerate([*same, *other, None, "://", "http://a.com/en/x"])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, key int, verdict int")
    listed = spark.createDataFrame([("a.com/x?a=1&b=2",), ("a.com/en/x",), ("",), (None,)], "url string")
    rules = spark.createDataFrame([("com/en/", "allow")], "rule string, verdict string")
    got = {r.page_id: r.verdict for r in U.judge_urls(df, rules, listed=listed).collect()}
    assert got == {k: "block" if k < len(same) else "allow" for k, _ in rows}


def test_sql_agrees(spark):
    pages = ["spam-farm.example.org", "spam-farm.example.org/en/728", "pills.example.de/buy?now=1", "a.b/x?b&a=1&ref=2", "com/en/9"]
    forms = ["http://{}", "x://U@{}#z", "https://{}"]
    extra = [f.format(u) for u in pages for f in forms] + ["https://spam-farm.example.org/?utm_source=1#z", "http://u@spam-farm.example.org:80", "http://a.com/?", "http://a.com/x?b&a=1&&ref=2?c#d?e", "http://A.b/x?a=1&&b"]
    # the first form of each page is listed, and nothing else but some of the odd URLs
    rows = [(7 * i if i % 2 else 7 * i + 1, u) for i, u in enumerate(URLS)] + [(None, "http://a.b/x?a=1&b")]
    rows += [(7000 + 7 * i + (u not in [forms[0].format(x) for x in pages]), u) for i, u in enumerate(extra)]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    want = con.execute(f"select page_id, host, path, rule, verdict from ({U.SQL})").fetchall()
    df, rules = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(U.RULES, "rule string, verdict string")
    got = U.judge_urls(df, rules, listed=U.listed_urls(df)).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    by_id = {r[0]: r for r in want}
    blocked = {u for i, u in rows if by_id[i][3] is None and by_id[i][4] == "block"}
    assert {f.format(u) for u in pages[:4] for f in forms} | {"https://spam-farm.example.org/?utm_source=1#z", "http://A.b/x?a=1&&b", "http://a.b/x?a=1&b"} <= blocked
    assert not {"http://a.com/x?b&a=1&&ref=2?c#d?e", "http://a.com/?"} & blocked


def test_empty(spark):
    df = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    rules = spark.createDataFrame(U.RULES, "rule string, verdict string")
    assert U.judge_urls(df.filter("false"), rules).count() == 0
    assert U.judge_urls(df, rules.filter("false")).first().verdict == "allow"
