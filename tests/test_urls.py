"""URL expressions against Python's urllib (differential) and the title/segment rules."""

from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from sitelore.functions import urls

CASES = [
    "http://a.com/a b",
    "https://Site.Example.edu/Course/Module-1/",
    "http://x.org/x;p=1/y;q=2?k=v#frag",
    "https://user:pw@www.Host.com:8080/p/q.html",
    "HTTPS://host.edu/path-x",
    "https://[::1]:80/v6",
    "ftp://files.example.org/pub/file.txt",
    "relative/path/only",
    "/root/relative?x=1",
    "https://host/a//b/",
    "mailto:someone@example.com",
    "https://www.site.edu",
    "https://host/blog/hw2solutions don't 10",
    "https://host/deck-3.pptx",
    "",
]


# written by hand: base domain, canonical URL and title of each case
EXPECTED = {
    "http://a.com/a b": ("a.com", "http://a.com/a b", "A B"),
    "https://Site.Example.edu/Course/Module-1/": ("site.example.edu", "https://site.example.edu/course/module-1", "Module 1"),
    "http://x.org/x;p=1/y;q=2?k=v#frag": ("x.org", "http://x.org/x;p=1/y?k=v", "Y"),
    "https://user:pw@www.Host.com:8080/p/q.html": ("host.com", "https://user:pw@www.host.com:8080/p/q.html", "Q"),
    "HTTPS://host.edu/path-x": ("host.edu", "https://host.edu/path-x", "Path X"),
    "https://[::1]:80/v6": ("::1", "https://[::1]:80/v6", "V6"),
    "ftp://files.example.org/pub/file.txt": ("files.example.org", "ftp://files.example.org/pub/file.txt", "File"),
    "relative/path/only": ("", "://relative/path/only", "Only"),
    "/root/relative?x=1": ("", ":///root/relative?x=1", "Relative"),
    "https://host/a//b/": ("host", "https://host/a//b", "B"),
    "mailto:someone@example.com": ("", "mailto://someone@example.com", "Someone@Example"),
    "https://www.site.edu": ("site.edu", "https://www.site.edu", "Home"),
    "https://host/blog/hw2solutions don't 10": ("host", "https://host/blog/hw2solutions don't 10", "Hw2Solutions Don'T 10"),
    "https://host/deck-3.pptx": ("host", "https://host/deck-3.pptx", "Deck 3"),
    "": ("", "://", "Home"),
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    out = df.select("url", urls.url_parts(F.col("url")).alias("p"), urls.base_domain(F.col("url")).alias("b"),
                    urls.canonical_url(F.col("url")).alias("c"), urls.title_from_url(F.col("url")).alias("t"))
    return {r["url"]: r for r in out.collect()}


@pytest.mark.parametrize("u", CASES)
def test_parts_match_urlparse(rows, u):
    p = urlparse(u)
    got = rows[u]["p"]
    assert (got.scheme, got.netloc, got.path, got.params, got.query, got.fragment) == \
        (p.scheme, p.netloc, p.path, p.params, p.query, p.fragment)
    assert got.hostname == (p.hostname or "")


@pytest.mark.parametrize("u", CASES)
def test_base_canonical_title(rows, u):
    assert (rows[u]["b"], rows[u]["c"], rows[u]["t"]) == EXPECTED[u]


def test_python_title_case(spark):
    words = ["hw2solutions don't", "hands-on LAB 3", "éTUDE àla", "x1y2z", "", "日本語guide", "guide日本語x", "مرحباguide",
             "ñandú ΑΒΓ где", "a-b-c 1a2b"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(urls.py_title(F.col("w"))).collect()]
    assert got == [w.title() for w in words]


def test_humanize_segment(spark):
    cases = {"module-3": "Module 3", "week_12": "Module 12", "part-1": "Part 1", "modules": "S",
             "unit": "Unnamed Module", "intro_to-ml": "Intro To Ml", "Topic-07": "Module 07"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r[0]: r[1] for r in df.select("s", urls.humanize_segment(F.col("s"))).collect()}
    assert got == cases


def test_py_strip(spark):
    s = " \t https://x.org/a \n　"
    got = spark.createDataFrame([(s,)], "s string").select(urls.py_strip(F.col("s"))).first()[0]
    assert got == s.strip()


def test_staged_split_equals_expression(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    a = {r["url"]: r["p"] for r in df.select("url", urls.url_parts(F.col("url")).alias("p")).collect()}
    b = {r["url"]: r["_u"] for r in urls.with_url_parts(df).collect()}
    assert a == b
