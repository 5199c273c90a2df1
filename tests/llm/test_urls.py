"""Hosts, fixed rules, mined rules and the index."""

import re

import pytest
from pyspark.sql import functions as F

from faultline.llm import common, queries, urls

ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://c/d", "x://EXAMPLE.com/en", "x://example.com/en/",
       "http://notexample.com/en/1", "http://a.net/es/", "http://net/fr/x", "http://x.org?/com/", "http://x.com#/en/", "http://x.com/\nq?r",
       "http://É.com/", "http://.com/", "http://a..net/es/1"]


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def fitting(host, path):
    own = [r for r in queries.PATH_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(own, key=lambda r: len(r.name), default=None)


def test_fixed_rules(spark):
    common.prepare(spark)
    table = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows = list(enumerate(ODD + table))
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "page_id long, url string, label string, tokens double")
    got = {r.page_id: r for r in urls.judge_urls(df, queries.PATH_RULES).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        host, path = host_path(url)
        rule = fitting(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name), url
        assert got[i].verdict == rule.verdict if rule else got[i].verdict in ("allow", "block")


def test_mined_rules_are_confident_supported_and_minimal(spark):
    common.prepare(spark)
    rows = [(["top=net", "dir=es", "query"], "block")] * 20 + [(["top=net", "dir=en"], "allow")] * 20
    rows += [(["top=com", "dir=es"], "allow")] * 10 + [(["top=org", "host=once"], "block")]
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = {body: (round(s, 3), c) for body, s, c in urls.mine_rules(df, support=0.1, confidence=0.9)}
    assert rules == {("query",): (0.392, 1.0), ("dir=es", "top=net"): (0.392, 1.0)}
    assert urls.mine_rules(df.limit(0)) == []


def test_the_index_finds_every_rule(spark):
    rules = [(("a", "b"), 0.5, 0.9), (("b", "c"), 0.4, 0.95), (("d",), 0.2, 1.0)]
    index = urls.inverted_index(rules)
    assert sum(map(len, index.values())) == 3
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "c"]), (3, ["d"]), (4, []), (5, None)], "i int, t array<string>")
    got = {r.i: r.c for r in df.select("i", urls.best_confidence(F.col("t"), rules).alias("c")).collect()}
    assert {i: None if c != c else c for i, c in got.items() if c is not None} == {1: 0.95, 3: 1.0}


def test_tokens_have_fixed_places(spark):
    df = spark.createDataFrame([(u,) for u in ODD], "url string")
    for r in df.select(urls.url_tokens(F.col("url")).alias("t")).collect():
        assert 0 < len(r.t) <= urls.TOKEN_PLACES and len(set(r.t)) == len(r.t)


def test_own_labels_and_empty_tables(spark):
    common.prepare(spark)
    df = spark.createDataFrame([(i, f"http://shop{i % 2}.site.org/x{i}") for i in range(40)], "page_id long, url string")
    labelled = df.select("url", F.when(F.col("page_id") % 2 == 0, "block").otherwise("allow").alias("label"))
    got = urls.judge_urls(df, [], labelled).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 == 0 else "allow") for r in got)
    assert urls.judge_urls(df.limit(0), queries.PATH_RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, []).collect()} == {"allow"}


def test_urls_have_all_their_tokens(spark):
    df = spark.createDataFrame([("https://m.free-bets.shop.example.org/en/news/77/a.html?page=2&ref=x#top",)], "url string")
    assert set(df.select(urls.url_tokens(F.col("url"))).first()[0]) == {
        "scheme=https", "top=org", "domain=example.org", "ending=html", "query", "fragment", "host=m", "host=free-bets", "host=shop",
        "host=example", "word=free", "word=bets", "dir=en", "dir=news", "dir=0", "dir=a.html", "query=page", "query=ref"}


def test_clean_urls_of_held_out_rules_are_allowed(spark):
    """Without a fixed rule its URLs are the method's: other rules' domains and languages are no evidence."""
    common.prepare(spark)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    got = urls.judge_urls(pages, queries.PATH_RULES).where("rule IS NULL").groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"allow": 1395}
    for out in queries.PATH_RULES:
        if out.verdict == "allow":
            left = [r for r in queries.PATH_RULES if r != out]
            held = urls.judge_urls(pages, queries.PATH_RULES).where(F.col("rule") == out.name).select("page_id")
            judged = urls.judge_urls(pages, left).join(held, "page_id").where("rule IS NULL")
            assert judged.where("verdict = 'block'").count() == 0


def test_a_word_that_goes_with_blocking_is_found(spark):
    """Evidence that the fixed rules do not test reaches URLs outside of them."""
    common.prepare(spark)
    rows = [f"http://s{i}.a.net/es/{i}" if i % 2 else f"http://s{i}.a.com/de/{i}?page=1" for i in range(400)]
    rows += [f"http://cheap-pills{i}.b.net/es/x?buy=1" for i in range(80)] + ["http://x.org/en/1?buy=2", "http://x.org/en/1?page=2"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.url: r.verdict for r in urls.judge_urls(df, queries.PATH_RULES).collect()}
    assert got["http://x.org/en/1?buy=2"] == "block" and got["http://x.org/en/1?page=2"] == "allow"


@pytest.mark.parametrize("name", ["op10_url_rules"])
def test_registered(name):
    assert name in queries.QUERIES
