import re

import pytest
from pyspark.sql import functions as F

from cityweave.llm import urlfilter


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    lower = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return ("".join(lower.get(c, c) for c in m[1]), m[2], m[3] or "") if m else ("", "", "")


def form(url):
    host, path, query = parts(url)
    host = re.sub(r"^www\.", "", re.sub(r":(80|443)?$", "", host))
    kept = sorted(p for p in query.split("&") if p and not re.match(urlfilter.TRACKING, p))
    return host + re.sub(r"/+$", "", path) + ("?" + "&".join(kept) if kept else "") if host else None


def brute(urls, listed, rules):
    known, out = {form(u) for u in listed} - {None}, []
    for i, u in urls:
        host, path, _ = parts(u)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        if fits:
            h, p, v = min(fits, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0], r[1], r[2] != "block"))
            out.append((i, host, path, h + p, v, None))
        else:
            out.append((i, host, path, None, "block" if form(u) in known else "allow", form(u) in known))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "listed").collect()), key=str)


URLS = [
    "http://a.com/en/x", "https://EXAMPLE.com/en/1", "http://www.Example.com/en/1", "http://m.example.com/en", "http://example.com.net/es/4", "http://net/fr/", "http://xnet/fr/", "http://a.net/en/1", "http://www.a.net/en/1/", "https://a.net:443/en/1#top",
    "http://a.net/en/1?utm_source=x", "http://a.net/en/1?b=2&a=1", "http://a.net/en/1?a=1&&b=2&ref=r", "http://a.net:8080/en/1", "http://com?x=/", "x", "", None, "://", "http://", "a://b://c/d", "http://o.org/" + "p/" * 200_000, "http://o.org/line\nbreak?q=\n", "http://com./en/", "http://ÉX.org/É",
]


def test_against_brute_force(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(3, URLS[7])] * 40 + [(None, URLS[8])]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, host string, key string, block int").repartition(4)
    listed = spark.createDataFrame([(u, "z") for u in URLS[7:12:2] + URLS[15:21] + URLS[21:23]], "url string, salt string")
    for blocks in (1, urlfilter.BLOCKS):  # one block: nearly all bits are set, the exact join decides
        assert got(urlfilter.judge(pages, listed, blocks=blocks)) == brute(rows, [r.url for r in listed.collect()], urlfilter.RULES)


def test_rules_of_one_length_and_bounds(spark):
    rows = [(1, "http://a.b.c/dd/e"), (2, "http://b.c/dd/"), (3, "http://q/")]
    rules = [("b.c", "/d", "allow"), ("c", "/dd/", "block"), ("a.b.c", "", "allow"), ("q", "/", "allow"), ("q", "/", "block")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert got(urlfilter.judge(pages, pages.limit(0), rules)) == brute(rows, [], rules)
    with pytest.raises(ValueError):
        urlfilter.judge(pages, pages, [("a", str(k), "block") for k in range(urlfilter.MOST_RULES + 1)])
    with pytest.raises(ValueError):
        urlfilter.judge(pages, pages, [("a", "/", "maybe")])
    assert [r.verdict for r in urlfilter.judge(pages, pages, []).collect()] == ["block"] * 3


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(none, none).count() == 0


def test_the_filter_lets_all_listed_and_few_others_through(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = urlfilter.bloom_blocks(keys, "key", 512)
    assert blocks.count() <= 512
    probe = spark.range(40_000).select("id", F.concat(F.lit("k"), "id").alias("key")).withColumn("block", urlfilter._block(F.col("key"), 512)).join(F.broadcast(blocks), "block", "left")
    every = F.lit(True)
    for w in range(urlfilter.WORDS):
        every &= F.col(f"w{w}").bitwiseAND(urlfilter._bit(F.col("key"), w)) != 0
    passed = probe.where(every)
    assert passed.where("id < 20000").count() == 20_000
    assert passed.where("id >= 20000").count() < 1_000


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    plan = urlfilter.judge(pages, pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan) and "BroadcastHashJoin" in plan
