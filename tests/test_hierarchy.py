"""Hierarchy semantics: prefix assignment (multi-module), detected modules, stored module."""

from pyspark.sql import functions as F

from sitelore.operators import hierarchy

SCHEMA = "course_id string, page_id bigint, url string, title string, content_type string"


def test_explicit_modules_prefix_and_nesting(spark):
    pages = spark.createDataFrame([
        ("c", 1, "https://s/course/module-1/", "M1", "module"),
        ("c", 2, "https://s/course/module-1/week-2", "W2", "module"),
        ("c", 3, "https://s/course/module-1/week-2/reading/9/", "R", "reading"),
        ("c", 4, "https://s/course/module-1/lecture-1", "L", "lecture"),
        ("c", 5, "https://s/course/module-10/x", "X", "other"),
        ("c", 6, "https://s/syllabus", "S", "course_overview"),
    ], SCHEMA)
    modules, assigned = hierarchy.build_modules_and_assignments(pages)
    got = sorted((r["page_id"], r["module_id"]) for r in assigned.collect())
    # page 3 sits in both nested modules; module-10 is not under module-1
    assert got == [(3, "1"), (3, "2"), (4, "1")]
    uncl = sorted(r[0] for r in hierarchy.unclassified_pages(pages, assigned).select("page_id").collect())
    assert uncl == [1, 2, 5, 6]  # landing pages of modules stay unclassified
    stored = {r["page_id"]: r["module_id"] for r in hierarchy.store_pages(pages, assigned).collect()}
    assert stored[3] == "2"  # last written = highest order_index
    idx = {r["module_id"]: r["order_index"] for r in modules.collect()}
    assert idx == {"1": 0, "2": 1}


def test_detected_modules_root_skipped_with_gap(spark):
    pages = spark.createDataFrame([
        ("d", 1, "https://s/index", "I", "other"),
        ("d", 2, "https://s/part-2/a", "A", "other"),
        ("d", 3, "https://s/intro/b", "B", "other"),
        ("d", 4, "https://s/x/part-2/c", "C", "other"),
    ], SCHEMA)
    modules, assigned = hierarchy.detect_modules(pages)
    got = {r["module_title"]: r["order_index"] for r in modules.collect()}
    # keys sorted: _root(0) intro(1) part-2(2); _root dropped, index gap kept; same leaf dir merges
    assert got == {"Intro": 1, "Part 2": 2}
    by_page = {r["page_id"]: r["module_title"] for r in assigned.collect()}
    assert by_page == {2: "Part 2", 3: "Intro", 4: "Part 2"}


def test_only_root_pages_form_one_module(spark):
    pages = spark.createDataFrame([("e", 1, "https://s/a", "A", "other"), ("e", 2, "https://s/", "H", "other")], SCHEMA)
    modules, assigned = hierarchy.detect_modules(pages)
    assert [(r["module_title"], r["order_index"]) for r in modules.collect()] == [("Root", 0)]
    assert assigned.count() == 2


def test_course_counts(spark):
    pages = spark.createDataFrame([
        ("c", 1, "https://s/module-1", "M", "module"), ("c", 2, "https://s/module-1/a", "A", "lecture"),
        ("c", 3, "https://s/other", "O", "other")], SCHEMA)
    counts = hierarchy.course_counts(hierarchy.build_hierarchy(pages)).first()
    assert (counts["module_count"], counts["page_count"]) == (1, 3)


def test_prefix_sweep_against_all_pairs(spark):
    """Nested, equal and look-alike module paths; one hot site over many ranges; clashing rows in other sites."""
    import random

    from pyspark.sql import functions as F

    from sitelore.operators import hierarchy
    rng = random.Random(4)
    names = ["m", "m-1", "m1", "m 2", "a", "b", "é", "z.html"]
    pages, modules, n = [], [], 0
    for site, size in (("hot", 900), ("a", 60), ("b", 60), ("none", 5)):
        for _ in range(size):
            n += 1
            path = "/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, 5))) + rng.choice(["", "/"])
            pages.append((site, n, f"https://{site}.edu{path}", f"t{n}", "lecture"))
        for k in range(size // 10 if site != "none" else 0):
            path = "".join("/" + rng.choice(names) for _ in range(rng.randint(0, 3)))
            modules.append((site, f"{site}-{k}", f"M{k}", k, path))
    df = spark.createDataFrame(pages, "course_id string, page_id long, url string, title string, content_type string")
    mods = spark.createDataFrame(modules, "course_id string, module_id string, module_title string, order_index long, module_path string")

    def path_of(url):
        return "/" + url.split("/", 3)[3].rstrip("/") if url.count("/") > 2 and url.split("/", 3)[3].rstrip("/") else ""

    want = sorted((c, i, m, k) for c, i, u, _, _ in pages for mc, m, _, k, p in modules
                  if mc == c and (path_of(u) == p or path_of(u).startswith(p + "/")))
    for partitions in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            out = hierarchy.assign_pages_by_prefix(df, mods)
            got = sorted((r.course_id, r.page_id, r.module_id, r.order_index) for r in out.collect())
            swept = hierarchy.swept_ranges(df.select(
                "*", F.lit("/m").alias("path"), F.lit(1).alias("kind"), F.lit(0).alias("order_index"),
                F.lit("").alias("module_id"), F.lit("").alias("module_title")))
            assert swept.count() == len(pages)  # one row a page, and the hot site in several ranges
            assert partitions == 1 or swept.filter("course_id = 'hot'").select("range").distinct().count() > 3
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert got == want, partitions
