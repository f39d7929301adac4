"""URL rules against a plain search, with more path lengths than any fixed bound and with hot rules."""

import random

from tidewater.llm import common, urls


def judged(url, rules, default="allow"):
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else default


def test_five_thousand_lengths(spark):
    rules = [("example.com", "/" + "a" * n, "block" if n % 3 else "allow") for n in range(5000)] + [("com", "/", "allow"), ("net", "", "block")]
    pages = [(i, f"http://w{i}.example.com/{'a' * (101 * i + 7)}b?x") for i in range(50)] + [(100, "http://example.com/" + "a" * 200_000), (101, "HTTPS://A.NET"), (102, "no url"), (103, "http:///x")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judged(u, rules) for i, u in pages}


def test_hot_rules_in_parts(spark, monkeypatch):
    """The same rows where nothing may be broadcast but the filter."""
    rng = random.Random(2)
    rules = [(h, p, rng.choice(["allow", "block"])) for h in ("com", "example.com", "a.example.com", "net", "b.net") for p in ("/", "/en/", "/en/x", "")]
    pages = [(i, rng.choice(["http://a.example.com/en/x1", "http://example.com/en/", f"http://q{i}.com/", "https://b.net/en", "ftp://zz.org/", None, f"http://b.net/{'en/' * (i % 3)}"])) for i in range(600)]
    x, r = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    monkeypatch.setattr(common, "BROADCAST", 0)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(x, r).collect()}
    assert got == {i: judged(u or "", rules) for i, u in pages}
