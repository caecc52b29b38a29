"""URL filters against plain Python."""

import pytest
from pyspark.sql import functions as F

from erascope.llm import url_filter as u

URLS = [
    "http://www.Bad.example.com/a/b/?utm_source=x&b=2&a=1#top",
    "https://bad.example.com/a/b?a=1&b=2",
    "https://bad.example.com:443/A/b?a=1&b=2",
    "https://user@bad.example.com./a/b?a=1&b=2",
    "https://ok.example.net/en/x",
    "https://example.net/en",
    "https://notexample.net/de/x",
    "HTTP://EXAMPLE.COM/de/x?http://y",
    "http://fr.org/fr/",
    "ftp://host?q#f",
    "http://",
    "no scheme",
    "",
    None,
    "http://ÀÉ.example.org/É?ref=1",
    "http://long.example.org/" + "x" * 100_000,
]


def plain(url):
    """(host, path) by the contract."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    name, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in name), tail[:end]


def plain_rule(host, path):
    found = [(len(r), r, v) for v, r in u.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(found)[1:] if found else (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, x, "h") for i, x in enumerate(URLS)] + [(None, URLS[0], None), (0, URLS[0], "h")], "page_id long, url string, host string")


def test_hosts_paths_and_rules(spark, pages):
    listed = spark.createDataFrame([(URLS[1],), (None,), ("junk",), (URLS[-1],), (URLS[1],)], "url string")
    got = u.judge(pages, listed, u.RULES).select("page_.page_id", "page_.url", "page_.host", F.col("host").alias("h"), "path", "rule", "verdict", "listed").collect()
    assert len(got) == len(URLS) + 2
    bad = {URLS[0], URLS[1], URLS[3], URLS[-1]}
    for r in got:
        assert (r.h, r.path) == plain(r.url)
        rule, verdict = plain_rule(r.h, r.path)
        assert r.rule == rule
        assert r.verdict == (verdict or ("block" if r.url in bad else "allow")), r.url
        assert r.listed == (verdict is None and r.url in bad)


def test_filter_in_a_shuffled_join_and_without_false_negatives(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")), F.lit(".org/p")).alias("url"))
    listed = pages.filter("page_id % 2 = 0").select("url")
    for blocks in (0, u.MAX_BLOCKS):
        got = u.judge(pages, listed, max_blocks=blocks)
        assert got.filter("verdict = 'block' and not possible").count() == 0
        wrong = got.select("page_.page_id", "verdict").filter("(page_id % 2 = 0 or page_id % 3 = 0) != (verdict = 'block')")
        assert wrong.count() == 0
        assert got.filter("possible and verdict = 'allow'").count() < 40  # false positives are few


def test_plan_has_no_python_and_only_hits_are_joined(spark, pages):
    listed = spark.createDataFrame([(URLS[1],)], "url string")
    plan = u.judge(pages, listed, u.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables_and_bad_rules(spark, pages):
    none = spark.createDataFrame([], "url string")
    assert {r.verdict for r in u.judge(pages, none).collect()} == {"allow"}
    assert u.judge(pages.limit(0), none, u.RULES).count() == 0
    assert u.without_blocked(pages, none).columns == pages.columns
    with pytest.raises(ValueError):
        u.judge(pages, none, [("deny", "net/")])
