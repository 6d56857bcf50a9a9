"""The temporal list join against a brute-force version."""

import random
import re

from pyspark.sql import functions as F

from quarry.llm import url_filters


def keys(url):
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::\d+)?(/[^?#]*)?", url or "")
    host = m[1].lower().removesuffix(".") if m else ""
    if not host:
        return set()
    labels, path = host.split("."), m[2] or ""
    domains = {("domain", ".".join(labels[i:])) for i in range(len(labels))}
    ends = [i for i in range(len(path) + 1) if i == len(path) or path[i] == "/" or path[i - 1 : i] == "/"]
    return domains | {("prefix", host + path[:i]) for i in ends}


def normal(pattern):
    if pattern is None:
        return None
    bare = re.sub(r"^([a-z]+://)?([^/@]*@)?", "", pattern)
    host, slash, path = bare.partition("/")
    return host.split(":")[0].lower().removesuffix(".") + slash + path


def judged(url, at, entries):
    on = []
    for kind, pattern in keys(url):
        last = None
        for k, p, action, t in entries:
            if (k, normal(p)) == (kind, pattern) and None not in (k, p, action, t, at) and action in ("add", "remove") and t <= at:
                last = max(last, (t, action)) if last else (t, action)
        if last and last[1] == "add":
            on.append((len(pattern), kind == "domain", pattern, kind))
    best = max(on, default=None)
    return best is not None, len(on), best and best[2], best and best[3]


def test_as_of_join(spark):
    rng = random.Random(6)
    urls = [None, "", "nothing", "http://", "https://A.b.example.com/x/y?q=1", "http://u@b.example.com:80/x/", "http://example.com", "http://b.example.com/x/y/z#f", "ftp://c.org./k//l", "http://b.example.com/xy"]
    patterns = [("domain", "example.com"), ("domain", "b.example.com"), ("prefix", "b.example.com/x/"), ("prefix", "b.example.com/x/y/"), ("prefix", "c.org/k//l"), ("prefix", "b.example.com/xy"), ("domain", "com"), ("prefix", "b.Example.com/x"), ("prefix", "B.example.com:80/x/y/"), ("prefix", "example.com"), ("prefix", "https://u@B.EXAMPLE.COM./X"), ("domain", "EXAMPLE.com:443"), (None, "c.org"), ("domain", None)]
    captures = [(k, rng.choice(urls), rng.choice([None, *range(12)])) for k in range(400)]
    captures += captures[:9]
    entries = [(*rng.choice(patterns), rng.choice(["add", "remove", "add", "other", None]), rng.choice([None, *range(10)])) for _ in range(150)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at long").withColumn("kind", F.lit("own")).repartition(3)
    e = spark.createDataFrame(entries, "kind string, pattern string, action string, at long")
    got = [tuple(r) for r in url_filters.url_filter(c, e).collect()]
    want = [(i, u, t, *judged(u, t, entries)) for i, u, t in captures]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert not any(r.blocked for r in url_filters.url_filter(c, e.limit(0)).collect())
    assert url_filters.url_filter(c.limit(0), e).count() == 0


def test_intervals(spark):
    e = spark.createDataFrame([("domain", "A.com.", "add", 5), ("domain", "a.com", "add", 6), ("domain", "a.com", "remove", 9), ("domain", "a.com", "add", 9), ("domain", "a.com", "add", 12)], "kind string, pattern string, action string, at long")
    got = sorted(tuple(r) for r in url_filters.intervals(e).collect())
    assert got == [("domain", "a.com", 5, 9), ("domain", "a.com", 12, url_filters.FOREVER)]


def test_prefixes_with_and_without_a_slash(spark):
    url = "http://example.com/a/b/c"
    for pattern, on in (("example.com/a", True), ("Example.com/a/", True), ("EXAMPLE.com:80", True), ("example.com/a/b/c", True), ("example.com/a/b/c/", False), ("example.com/A", False), ("example.com/a/b/cd", False), ("example.co", False), ("example.com/a/b/", True)):
        c = spark.createDataFrame([(1, url, 5)], "page_id long, url string, fetched_at long")
        e = spark.createDataFrame([("prefix", pattern, "add", 1)], "kind string, pattern string, action string, at long")
        assert [r.blocked for r in url_filters.url_filter(c, e).collect()] == [on], pattern
