"""Discovery on the F1 frontier: the FIXTURES goldens and the dedup-before-filter rule."""

from pyspark.sql import functions as F

from sitelore.operators import frontier


def test_fixture_goldens(tables01):
    pages = frontier.discover_pages(tables01["links"], tables01["courses"])
    assert tables01["links"].count() == 398
    assert pages.count() == 252
    counts = {r[0]: r[1] for r in pages.groupBy("content_type").count().collect()}
    assert counts == {"module": 19, "lecture": 25, "quiz": 31, "assignment": 30, "pdf": 21, "reading": 25,
                      "course_overview": 15, "announcement": 12, "video": 13, "reference": 16, "project": 31,
                      "other": 14}


def test_dedup_before_filter(spark):
    links = spark.createDataFrame(
        [("c1", 1, "https://s.edu/a#top", None), ("c1", 2, "https://s.edu/a", None), ("c1", 3, "https://S.EDU/b/", "B"),
         ("c1", 4, "https://s.edu/b", "dup")], "course_id string, ord bigint, url string, title string")
    courses = spark.createDataFrame([("c1", "https://s.edu/")], "course_id string, url string")
    got = {r["page_id"]: r["title"] for r in frontier.discover_pages(links, courses).collect()}
    assert got == {3: "B"}  # the clean twin of a fragment link is lost, as in the reference
    got2 = {r["page_id"] for r in frontier.discover_pages(links, courses, filter_first=True).collect()}
    assert got2 == {2, 3}


def test_limit_frontier_keeps_first_n(spark):
    links = spark.range(0, 50).select(F.lit("c").alias("course_id"), F.col("id").alias("ord"),
                                      F.concat(F.lit("https://s/"), F.col("id").cast("string")).alias("url"))
    assert sorted(r[0] for r in frontier.limit_frontier(links, 7).select("ord").collect()) == list(range(7))


def test_all_anchor_forms(spark):
    from sitelore.sources import html
    page = ("<a href=\"/d\">double</a> <A class=x HREF='s?a=1'>sin<b>gle</b></A> <a href=bare>bare</a> "
            "<a data-href='no' href = \"https://o.org/x\" title=t><img src=i> <span>in side</span></a>"
            "<a href=\"//c.org/\"></a><a name=n>none</a><abbr href='q'>not</abbr>")
    df = spark.createDataFrame([(7, "https://www.s.edu/p", page)], "page_id bigint, url string, html string")
    got = [tuple(r) for r in html.extract_links(df).orderBy("pos").collect()]
    assert got == [("s.edu", 7, 0, "https://www.s.edu/d", "double"), ("s.edu", 7, 1, "https://www.s.edu/s?a=1", "single"),
                   ("s.edu", 7, 2, "https://www.s.edu/bare", "bare"), ("s.edu", 7, 3, "https://o.org/x", "in side"),
                   ("s.edu", 7, 4, "https://c.org/", None)]


def test_failed_payloads_stay_as_rows(spark):
    from sitelore.sources import payloads
    df = spark.createDataFrame([(1, '{"links":["u"]}'), (2, "oops"), (3, '{"links":[]}'), (4, None)], "ord bigint, payload string")
    got = {r["ord"]: (r["url"], r["success"], r["error"]) for r in payloads.normalize_links(df).collect()}
    assert got == {1: ("u", True, None), 2: (None, False, payloads.NO_LINKS), 3: (None, True, None), 4: (None, False, payloads.NO_LINKS)}
    crawl = spark.createDataFrame([(1, '{"data":[{"url":"u"}]}'), (2, "oops"), (3, '{"x":1}')], "ord bigint, payload string")
    got = {r["ord"]: (r["url"], r["success"]) for r in payloads.normalize_crawl_payload(crawl).collect()}
    assert got == {1: ("u", True), 2: ("", False), 3: ("", False)}


def test_stable_ids_survive_shifted_positions_and_differ_by_site(spark):
    courses = spark.createDataFrame([("a", "https://s.edu"), ("b", "https://s.edu")], "course_id string, url string")
    schema = "course_id string, ord bigint, url string, title string"
    first = spark.createDataFrame([("a", 0, "https://s.edu/x", None), ("b", 0, "https://s.edu/x", None)], schema)
    later = spark.createDataFrame([("a", 0, "https://s.edu/new", None), ("a", 5, "https://S.edu/x/", None)], schema)
    ids = {(r["course_id"], r["canonical"]): r["page_id"] for r in frontier.discover_pages(first, courses, stable_ids=True).collect()}
    again = {(r["course_id"], r["canonical"]): r["page_id"] for r in frontier.discover_pages(later, courses, stable_ids=True).collect()}
    assert len(set(ids.values())) == 2 and again["a", "https://s.edu/x"] == ids["a", "https://s.edu/x"] >= 0


def test_rediscovery_keeps_ids_and_reports_changes(spark):
    import uuid

    from sitelore.operators import frontier
    from sitelore.session import scratch_path
    from sitelore.sources.store import BucketTable
    courses = spark.createDataFrame([("a", "https://s.edu"), ("b", "https://t.edu")], "course_id string, url string")
    schema = "course_id string, ord bigint, url string, title string"

    def found(*rows):
        return frontier.discover_pages(spark.createDataFrame([*rows], schema), courses, stable_ids=True, with_ord=True)

    before = found(("a", 0, "https://s.edu/x", "X"), ("a", 1, "https://s.edu/y", "Y"), ("a", 2, "https://s.edu/z", "Z"),
                   ("b", 0, "https://t.edu/x", "X"))
    after = found(("a", 0, "https://s.edu/new", "N"), ("a", 1, "https://s.edu/x/", "X"), ("a", 3, "https://s.edu/y", "Y"),
                  ("b", 0, "https://t.edu/x", "X2"))
    diff = frontier.rediscover(before, after)
    assert {(r.course_id, r.canonical, r.change, r.old_ord, r.new_ord) for r in diff.collect()} == {
        ("a", "https://s.edu/new", "added", None, 0), ("a", "https://s.edu/x", "changed", 0, 1),
        ("a", "https://s.edu/y", "moved", 1, 3), ("a", "https://s.edu/z", "vanished", 2, None),
        ("b", "https://t.edu/x", "changed", 0, 0)}
    ids = {(r.course_id, r.canonical): r.page_id for r in before.collect()}
    assert all(ids[r.course_id, r.canonical] == r.page_id for r in after.collect() if (r.course_id, r.canonical) in ids)
    stored = before.selectExpr("course_id", "page_id", "url", "title", "content_type", "'scraped' AS status")
    pages = BucketTable.create(stored, scratch_path(spark, f"tables/rediscovery-{uuid.uuid4().hex}"), ["course_id", "page_id"])
    for _ in range(2):  # applied again it gives the same table
        frontier.store_rediscovery(pages, diff)
        assert {(r.url, r.title, r.status) for r in pages.read().collect()} == {
            ("https://s.edu/new", "N", "discovered"), ("https://s.edu/x/", "X", "scraped"), ("https://s.edu/y", "Y", "scraped"),
            ("https://s.edu/z", "Z", "vanished"), ("https://t.edu/x", "X2", "scraped")}
    frontier.store_rediscovery(pages, frontier.rediscover(after, before))
    assert ("https://s.edu/z", "Z", "discovered") in {(r.url, r.title, r.status) for r in pages.read().collect()}
