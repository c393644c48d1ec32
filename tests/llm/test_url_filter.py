"""URL filter: splitting and rules against plain code, training against numpy, odd rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from newslens.llm import url_filter as U


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def _rule(host, path):
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in U.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


URLS = [None, "", "no scheme", "://", "http://", "https://ORG/", "http://org", "x://org/?q", "http://a.ORG/b?c#d",
        "http://example.org/es/1", "http://m.example.org/en/12#x", "http://example.org/en/2", "http://notexample.org/es/",
        "http://com/fr/x", "http://A.com/de/x?y", "http://b.com/fr", "http://xcom/de/", "http://ÄÖ.Com/de/é",
        "ftp://a://b/c", "http://h?p/de/", "http://h#f", "http://a.net/en/" + "long" * 5000]
URLS += ["".join(p) for p in itertools.product(["http://", ""], ["example.org", "x.com", "com", "net"], ["/es/", "/de/1", "/fr/?a", "/en/1", ""])]


def test_split_and_rules_against_plain(spark):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] + [(0, None, "old")], "page_id long, url string, host string")
    got = U.filter_urls(df, "url", [0.0] * 64).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = _split(r.url)
        rule, verdict = _rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "block") and r.p_block == 0.5  # no weights: one half, at the threshold
    clash = spark.createDataFrame([("http://b.com/fr/1", 7)], "host string, verdict int")
    assert U.filter_urls(clash, "host", [0.0] * 64).first().rule == "com/fr/"
    assert U.filter_urls(df.limit(0), "url", [0.0] * 64).collect() == []


def test_training_against_numpy(spark):
    rows = [("http://aa.com/x1", 1), ("http://ab.com/y", 0), ("http://aa.net/", 1), ("http://cc.org/z?q", 0), ("http://cd.org", 0)]
    df = spark.createDataFrame([*rows, (None, 1), ("http://q.com", None)], "url string, blocked int")
    buckets, steps = 64, 7
    got = np.array(U.train(df, steps=steps, buckets=buckets))
    host, path = U.split_url("url")
    f = {r.url: r.f for r in df.where("url is not null").select("url", U.url_features(host, path, U.NGRAMS, buckets).alias("f")).collect()}
    x = np.zeros((len(rows), buckets))
    for i, (u, _) in enumerate(rows):
        assert len(set(f[u])) == len(f[u]) and f[u][0] == 0
        x[i, f[u]] = 1 / len(f[u]) ** 0.5
    y = np.array([b for _, b in rows], float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w = np.zeros(buckets)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w = w * (1 - U.RATE * U.L2) - U.RATE / len(y) * (x.T @ ((p - y) * weight))
    assert np.allclose(got, w, atol=1e-9)
    assert U.train(df.limit(0), buckets=8) == [0.0] * 8


def test_unseen_sites(spark):
    weights = U.train(U.labelled_urls(spark))
    sites = {"http://www.super-casino.example.com/en/5": "block", "https://my-cheap-pills.example.net/a": "block",
             "http://blog.public-library.example.net/en/77": "allow", "https://garden-history.example.com/en/9": "allow"}
    df = spark.createDataFrame([(u,) for u in sites], "url string")
    assert {r.url: r.verdict for r in U.filter_urls(df, "url", weights).collect()} == sites


def test_no_python_on_the_main_path(spark):
    df = spark.range(5).select(F.concat(F.lit("http://a.com/"), "id").alias("url"))
    plan = U.filter_urls(df, "url", [0.1] * 64)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
