"""URL rules against a plain loop; the cascade against a set."""

import re

from pyspark.sql import functions as F

from corvane.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "http://a.NET", "http://a.net/", "https://x.example.net/en/a?b#c", "https://example.net/en/", "https://example.net/enx",
    "http://example.com/de/", "http://myexample.com/de/1", "ftp://a.b.example.com/de/x", "http://o.org/fr/x?y", "http://org/fr/", "http://a.org?x/fr/",
    "http://a.org#/fr/", "http://..net/", "http://net/en/", "x://y://example.com/de/", "http://EXAMPLE.Net/EN/", "http://example.net./en/",
]


def plain(url, rules, default="allow"):
    m = re.search(r"://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans(U.UPPER, U.LOWER))
    fits = []
    for rule, verdict in rules:
        h, p = U.split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, verdict))
    rule, verdict = max(fits)[1:] if fits else (None, default)
    return host, path, rule, verdict


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    want = {i: plain(u, U.RULES) for i, u in enumerate(URLS)}
    for words in (U.MAX_WORDS, 0):  # by the cascade, and by the join where it may not be built
        found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(pages, list(U.RULES), max_words=words).collect()}
        assert found == want
    assert U.judge_urls(pages.limit(0), list(U.RULES)).count() == 0
    assert {r["verdict"] for r in U.judge_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("hash(key) % 7 = 0").unionByName(spark.createDataFrame([("absent",)], "key string"))
    levels = U.build_cascade(universe, listed)
    assert len(levels) > 1
    wrong = universe.where(U.listed_by(levels, F.col("key")) != F.expr("hash(key) % 7 = 0"))
    assert wrong.count() == 0
    assert U.build_cascade(universe, listed, max_words=1) is None
