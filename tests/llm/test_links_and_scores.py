"""URL targets against the standard library and SQL on a fixture; inclusion scores against enumeration."""

from __future__ import annotations

import html as entities
import math
from collections import defaultdict
from urllib.parse import urljoin

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lumora.llm import segsample, url_filter
from lumora.llm.queries import tokenizer_path

TARGETS = ["/de/x", "de/y", "../z", "./a/../b", "//other.net/q", "?x=1&amp;y=2", "http://a.net/?u=1&amp;v=2", "#top", "", "a&quot;b", "../../../up?k=../v#f"]


def test_targets_are_resolved(spark):
    bases = ["http://h.org/p/q/r?s=1#t", "https://h.org", "http://h.org/p"]
    rows = [(b, t) for b in bases for t in TARGETS] + [("no scheme", "/x"), ("no scheme", "http://k.org/")]
    got = {(r.b, r.t): r.x for r in spark.createDataFrame(rows, "b string, t string").select("b", "t", url_filter.resolved(F.col("b"), F.col("t")).alias("x")).collect()}
    for b in bases:
        for t in TARGETS:
            if t in ("", "#top"):
                assert got[b, t] is None
            elif b != "https://h.org" or not t.startswith("?"):
                assert got[b, t] == urljoin(b, entities.unescape(t)), (b, t)
    assert got["no scheme", "/x"] is None and got["no scheme", "http://k.org/"] == "http://k.org/"


def pages():
    link, fresh = '<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='0; url={}'>"
    rows = [(1, "http://a.org/p/1", link.format("2") + link.format("/p/3")), (2, "http://a.org/p/2", None), (3, "http://a.org/p/3", fresh.format("//bad.net/x?a=1&amp;b=2")), (4, "http://bad.net/x?a=1&b=2", "")]
    rows += [(5, "http://c.org/x", fresh.format("/y") + fresh.format("../z")), (6, "http://c.org/z", None), (7, "http://c.org/y", link.format("http://example.com/de/1")), (8, None, link.format("http://bad.net/")), (9, "no scheme", link.format("/p/3"))]
    rows.append((10, "http://long.org/1", "x" * 3_000_000 + link.format("http://bad.net/z")))
    return rows


def test_query_equals_sql_on_linked_pages(spark):
    schema = "page_id long, url string, html string"
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(pages(), schema)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages())
    assert got == sorted(con.execute(url_filter.ORACLE).fetchall())
    assert [r[0] for r in got if r[4] == "block"] == [1, 2, 3, 4, 5, 6, 7, 10]


def test_inclusion_scores_are_unbiased():
    """The mean of p / inclusion over the draws that hold a segmentation is its probability p, for each of them."""
    v = segsample.vocabulary(tokenizer_path("piece"))
    n, checked = 6000, 0
    for text in (b"ab the", b"qxzv"):
        ways = segsample.Sampler(v, [text], np.zeros(1, np.uint64))
        p = {tuple(ways.lattices.piece[path].tolist()): math.exp(lp) for lp, _, _, path in ways.top(10_000)[0]}
        sampler = segsample.Sampler(v, [text] * n, np.arange(n, dtype=np.uint64) * np.uint64(104729))
        weights = defaultdict(list)
        for found in sampler.top(2):
            for lp, _, inclusion, path in found:
                assert 0 < inclusion <= 1
                weights[tuple(sampler.lattices.piece[path].tolist())].append(math.exp(lp) / inclusion)
        for key, q in p.items():
            if q >= 0.001:
                w = np.concatenate((weights[key], np.zeros(n - len(weights[key]))))
                assert abs(w.mean() - q) < 5 * w.std() / math.sqrt(n) + 2e-4, (key, q, w.mean())
                checked += 1
        assert abs(sum(sum(w) for w in weights.values()) / n - 1) < 0.05
    assert checked >= 3
