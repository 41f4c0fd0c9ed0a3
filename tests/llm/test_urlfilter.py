import re

from readloom.llm import queries, urlfilter

RULES = [*queries.URL_RULES, ("evil.org", "/a", "block"), ("sub.evil.org", "", "allow"), ("", "", "allow")]
URLS = [
    None, "", "nothing", "http://COM/", "http://x.Com", "http://x.com/", "https://example.com/en/1", "http://a.EXAMPLE.com/EN/",
    "http://www.example.com/en/x?y=/", "http://notexample.com/en/", "ftp://b.net/es/", "b.net/es/", "x://b.net/fr/#://c.com/",
    "http://evil.org/abc", "http://q.evil.org/b", "http://w.sub.evil.org", "http://sub.evil.org/a", "http:///p", "http://a..com/",
    "http://ÀÉ.com/é/", "http://h?x/y", "http://" + "a." * 60 + "com/" + "p" * 3000, "http://u:p@example.com:80/en/", "a\n://b.net/es/\nq",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (h or not host)
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_against_brute_force(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(1, "http://x.com/", "", ""), (None, "http://x.com/", "", "")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    for chosen in (RULES, queries.URL_RULES):
        got = urlfilter.judge(df, spark.createDataFrame(chosen, "host string, path string, verdict string")).collect()
        key = lambda r: tuple("" if x is None else str(x) for x in r)
        want = [(i, *brute(u, chosen)) for i, u, *_ in rows]
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_no_rules_and_no_pages(spark):
    df = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urlfilter.judge(df, none, "block").collect()] == [(1, "a.b", "/", None, "block")]
    assert urlfilter.judge(df.limit(0), none).count() == 0


def test_block_wins_among_equals(spark):
    df = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("A.b", "/", "block")], "host string, path string, verdict string")
    assert urlfilter.judge(df, rules).first().verdict == "block"
