"""Rules by Bloom filter and exact join against trying every rule."""

import random

import brute

from axisfield.llm import queries
from axisfield.llm import url_filters as U

SF = "/root/testdata/sf0.001"


def rules_frame(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def check(spark, urls, rules, **options):
    rows = [(k, u) for k, u in enumerate(urls)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), rules_frame(spark, rules), **options).collect()
    assert len(got) == len(rows)
    fit = [(h.lower(), p, v) for h, p, v in rules if h and p is not None]
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute.judged(urls[r.page_id], fit), urls[r.page_id]


URLS = [
    None, "", "no scheme", "http://", "http:///a", "https://A.Example.ORG/en/12", "https://example.org", "https://example.org?x=/en/1", "https://badexample.org/es/", "http://www.example.org/es/a#b",
    "http://org/", "ftp://x.com/de/1?q=http://example.org/", "http://com/fr/", "http://.com/de/", "http://com./de/", "http://a..com/de/", "x://a.com/fr/\n", "http://a.com/FR/", "http://user@a.com:80/de/", "http://ÄÖ.com/de/é", "a://b://c.org/",
]


def test_hostile_urls(spark):
    check(spark, URLS, queries.URL_RULES)
    check(spark, URLS, [(None, "/", "block"), ("", "/", "block"), ("com", None, "allow"), ("COM", "", "block"), ("com", "/fr/", "block"), ("com", "/fr/", "allow"), ("org", "/en", "block")])


def test_empty_lists_and_tables(spark):
    check(spark, URLS, [])
    none = U.judge(spark.createDataFrame([], "page_id long, url string"), rules_frame(spark, queries.URL_RULES))
    assert none.count() == 0 and none.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    odd = spark.createDataFrame([(1, "http://a.com/de/", "mine", "x")] * 3, "page_id long, url string, verdict string, `a.b` string")
    assert [tuple(r) for r in U.judge(odd, rules_frame(spark, queries.URL_RULES)).collect()] == [(1, "http://a.com/de/", "x", "a.com", "/de/", "com/de/", "block")] * 3


def _many(n):
    rng = random.Random(5)
    names = [f"h{k}" for k in range(40)]
    host = lambda: ".".join(rng.choices(names, k=rng.randint(1, 3)))
    path = lambda: "/" + "/".join(rng.choices("abcde", k=rng.randint(0, 4)))
    rules = {(host(), path()): rng.choice(("allow", "block")) for _ in range(n)}
    return [f"http://{host()}.{host()}{path()}{path()}" for _ in range(n)] + ["http://h1.h2/a/b"] * n, [(h, p, v) for (h, p), v in rules.items()]


def test_long_lists(spark, monkeypatch):
    urls, rules = _many(600)
    check(spark, urls, rules)
    # the ways beyond the broadcasts give the same
    monkeypatch.setattr(U, "BROADCAST_RULES", 3)
    check(spark, urls, rules)
    monkeypatch.setattr(U, "FILTER_BLOCKS", 1)
    check(spark, urls, rules)


def test_a_filter_passes_all_that_is_listed_and_little_else(spark):
    listed = U.canonical(rules_frame(spark, [(f"a{k}.com", "/x", "block") for k in range(3000)]))
    asked = spark.range(6000).selectExpr("concat('a', id, '.com') as rule_host", "'/x' as rule_path", "id")
    for bits, most in ((12, 60), (1, 3000)):
        blocks = U.block_count(3000, bits)
        passed = {r.id for r in U.possible(asked, U.bloom(listed, blocks), blocks).collect()}
        assert {*range(3000)} <= passed and len(passed) - 3000 <= most
    # a filter that is nearly full lets unlisted ones pass: the exact join holds them back
    assert len(passed) > 3500
    old, U.BITS_A_KEY = U.BITS_A_KEY, 1
    try:
        check(spark, [f"http://a{k}.com/x" for k in range(0, 6000, 7)], [(f"a{k}.com", "/x", "block") for k in range(3000)])
    finally:
        U.BITS_A_KEY = old


def test_op12(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op12_blocked_bloom(spark, SF).collect()
    assert len(rows) == len(urls) and {r.verdict for r in rows} == {"allow", "block"}
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute.judged(urls[r.page_id], queries.URL_RULES)
