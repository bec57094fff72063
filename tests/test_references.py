"""References: the standard's example tables, the library function of the reference language, and whole pages."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from sitelore.functions import urls
from sitelore.sources import html

BASE = "http://a/b/c/d;p?q"
# fixed values: RFC 3986, sections 5.4.1 and 5.4.2
NORMAL = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g",
          "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
          "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
          "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
          "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
          "../../g": "http://a/g"}
ABNORMAL = {"../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
            "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
            "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
            "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x",
            "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x",
            "http:g": "http:g"}


def resolve(spark, pairs):
    df = spark.createDataFrame([(i, r, b) for i, (r, b) in enumerate(pairs)], "i long, r string, b string")
    out = df.select("i", urls.resolve_reference(F.col("r"), F.col("b")).alias("u")).collect()
    return [r.u for r in sorted(out)]


def test_standard_examples(spark):
    table = {**NORMAL, **ABNORMAL}
    assert dict(zip(table, resolve(spark, [(r, BASE) for r in table]))) == table


def test_random_references_like_urljoin(spark):
    """Without an authority of their own: there urljoin leaves dot segments, the standard does not."""
    rng = random.Random(9)
    parts = ["a", "b-1", ".", "..", "x.html", "é", "%20"]
    bases = ["http://h.edu", "http://h.edu/", "https://h.edu/a/b?q=1#f", "https://h.edu/a/./b/c.html", "http://h.edu:80/x/"]
    pairs = []
    for _ in range(600):
        ref = rng.choice(["", "/"]) + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) + rng.choice(
            ["", "/", "?q", "#f", "?q=/../x#f"])
        if ref and not ref.startswith("//"):
            pairs.append((ref, rng.choice(bases)))
    want = [urljoin(b, r) for r, b in pairs]
    assert resolve(spark, pairs) == want


def test_pages_with_and_without_base(spark):
    rows = [(1, "https://s.edu/course/week-1/index.html?x=1",
             '<a href="lecture-1.html">L</a><a href="../week-2/?p=2#top">W</a><a href="?y">Q</a><a href="#s">S</a>'
             "<a href=' //o.org/x&amp;y '>O</a><a href=\"mailto:t@s.edu\">M</a>"),
            (2, "https://s.edu/course/", '<!-- <base href="/no/"> --><base target="_top" href="../files/"><a href="./a/../b.pdf">B</a>'),
            (3, "https://s.edu", '<a href="x\n/y">line break</a><a href="">self</a>')]
    out = html.extract_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.src_page, r.url) for r in sorted(out, key=lambda r: (r.src_page, r.pos))] == [
        (1, "https://s.edu/course/week-1/lecture-1.html"), (1, "https://s.edu/course/week-2/?p=2#top"),
        (1, "https://s.edu/course/week-1/index.html?y"), (1, "https://s.edu/course/week-1/index.html?x=1#s"),
        (1, "https://o.org/x&y"), (1, "mailto:t@s.edu"), (2, "https://s.edu/files/b.pdf"),
        (3, "https://s.edu/x/y"), (3, "https://s.edu")]
