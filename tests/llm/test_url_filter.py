import math
import re

from provenir.llm import url_filter
from provenir.llm.url_filter import RULES, judge_urls

URLS = [
    "http://a.net/x", "http://net/x", "http://www.example.net/en/1", "http://www.example.net/de/1", "https://SHOP.Example.COM/de/2?q=/en/", "https://example.com/fr/2", "http://x.org/fr/3", "http://x.org/en/3",
    "http://notnet/x", "http://xexample.net/en/", "ftp://a.net", "no scheme", "", None, "http://spam-farm.example.org/en/1", "http://a.net?x=1", "http://b.org/fr", "x://y://z.net/", "http://a.net/#/en/",
]


def expected(url):
    url = url or ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_rules_and_method(spark):
    pages = spark.createDataFrame([(k, u, "h", "c") for k, u in enumerate(URLS)] + [(0, URLS[0], "h", "c"), (None, "http://q.com/", "h", "c")], "page_id long, url string, html string, host string")
    got = judge_urls(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path, best = expected(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
            assert r["verdict"] == best[0] if best else r["verdict"] in {"allow", "block"}


def test_no_labels_and_no_rows(spark):
    one = judge_urls(spark.createDataFrame([(1, "http://q.com/")], "page_id long, url string")).collect()
    assert [r["verdict"] for r in one] == ["allow"]
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_suffixes_are_counted_over_all_rows(spark, monkeypatch):
    seen = []
    rates = url_filter._rates
    monkeypatch.setattr(url_filter, "_rates", lambda *a: seen.append(rates(*a)) or seen[-1])
    urls = [f"http://h{k}.net/x" for k in range(30)] + [f"http://h{k}.org/fr/x" for k in range(10)] + ["http://a.xyz/", "http://a.xyz/"]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), sample=8).collect()
    got = {r["suffix_key"]: (round(math.expm1(r["f_suffix_log_n"])), round(r["f_suffix_rate"], 6)) for r in seen[0].collect()}
    assert got == {"net": (30, round(31 / 32, 6)), "org": (10, round(1 / 12, 6)), "xyz": (2, 0.5)}
    assert len(rows) == len(urls) and all(r["block_score"] is not None for r in rows)
