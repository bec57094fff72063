"""Stored tables: copy-on-write, retries, plans without an exchange of the store, content and mutation operators on them."""

import uuid

import pytest

from sitelore.operators import content, state
from sitelore.session import scratch_path
from sitelore.sources.store import PART, BucketTable

PAGES = "course_id string, page_id bigint, title string"


def folder(spark, name="store"):
    return scratch_path(spark, f"tables/test-{name}-{uuid.uuid4().hex}")


def files(table):
    from pathlib import Path
    return {p: p.stat().st_mtime_ns for p in Path(table.path).rglob("*.parquet")}


@pytest.fixture
def pages(spark):
    rows = spark.range(400).selectExpr("concat('c', id % 3) AS course_id", "id AS page_id", "concat('t', id) AS title")
    return BucketTable.create(rows, folder(spark), ["course_id", "page_id"], parts=8, buckets=2)


def contents(table):
    return sorted(map(tuple, table.read().collect()))


def test_upsert_rewrites_touched_partitions_only_and_can_be_repeated(spark, pages):
    before, want = files(pages), {(c, p): t for c, p, t in contents(pages)}
    new = spark.createDataFrame([("c0", 0, "new"), ("c1", 0, "other site, same id")], PAGES)
    want |= {("c0", 0): "new", ("c1", 0): "other site, same id"}
    for _ in range(2):
        state.upsert_stored(pages, new)
        assert contents(pages) == sorted((c, p, t) for (c, p), t in want.items())
    after = files(pages)
    untouched = {f for f in before if after.get(f) == before[f]}
    touched = {r[PART] for r in new.withColumn(PART, pages.part()).collect()}
    assert {int(f.parent.name.split("=")[1]) for f in before} - {int(f.parent.name.split("=")[1]) for f in untouched} == touched
    # a rewritten partition has one file a bucket again
    assert all(sum(f.parent.name == f"{PART}={k}" for f in after) <= 2 for k in touched)


def test_delete_by_site_leaves_pages_of_other_sites_with_the_same_id(spark, pages):
    state.upsert_stored(pages, spark.createDataFrame([("c0", 1, "same id")], PAGES))
    for _ in range(2):
        state.delete_stored({"pages": pages}, spark.createDataFrame([("c1",), ("none",)], "course_id string"))
        got = contents(pages)
        assert ("c0", 1, "same id") in got and not any(c == "c1" for c, _, _ in got)


def test_partitions_without_rows_go(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], PAGES)
    table = BucketTable.create(rows, folder(spark), ["course_id", "page_id"], parts=64, buckets=1)
    table.delete(rows.where("course_id = 'a'"))
    assert contents(table) == [("b", 2, "y")] and len(files(table)) == 1
    table.delete(rows)
    assert contents(table) == [] and not files(table)
    table.upsert(rows.where("course_id = 'a'"))
    assert contents(table) == [("a", 1, "x")]
    table.upsert(rows.limit(0))
    assert contents(table) == [("a", 1, "x")]


def test_files_can_be_opened_again(spark, pages):
    again = BucketTable.open(spark, pages.path, PAGES, pages.keys, parts=8, buckets=2)
    assert contents(again) == contents(pages)
    again.upsert(spark.createDataFrame([("c9", 9, "z")], PAGES))
    assert ("c9", 9, "z") in contents(again)


def test_the_callers_session_keeps_its_settings(spark, pages):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    pages.upsert(spark.createDataFrame([("c9", 9, "z")], PAGES))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


CONTENT = "page_id bigint, course_id string, url string, markdown string, retrieved_at bigint, content_hash string"


@pytest.fixture
def store(spark):
    rows = spark.createDataFrame([(i, f"c{i % 2}", f"u{i % 20}", f"text {i}", i, f"h{i % 40}") for i in range(80, 120)], CONTENT)
    return content.ContentStore.create(rows, folder(spark, "content"), parts=4, buckets=8)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above(plan, table):
    """Exchanges on the way from the scan of a table up to the first join above it."""
    lines, found = plan.split("\n"), []
    for k, line in enumerate(lines):
        if "FileScan" in line and table in line:
            depth = len(line) - len(line.lstrip(" :+-|*"))
            for above in reversed(lines[:k]):
                at = len(above) - len(above.lstrip(" :+-|*"))
                if at < depth:
                    depth = at
                    if "Join" in above or "Union" in above:
                        break
                    if "Exchange" in above:
                        found.append(above.strip())
    return found


def test_splits_and_latest_do_not_shuffle_the_store(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frontier = spark.range(1000).selectExpr("concat('u', id % 50) AS url", "id AS page_id", "'c' AS course_id")
        flagged = store.split(frontier)
        plan = plan_of(flagged)
        assert plan.count("Join") == 1 and plan.count("FileScan") == 1 and not exchanges_above(plan, store.table.name)
        assert sum(r.hit for r in flagged.collect()) == 400
        plan = plan_of(store.latest())
        assert "Exchange" not in plan
        new = frontier.selectExpr("url", "page_id", "concat('h', page_id % 60) AS content_hash")
        assert not exchanges_above(plan_of(store.unknown(new)), store.table.name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_store_equals_the_operators_on_plain_tables(spark, store):
    rows = spark.createDataFrame([(i, f"c{i % 2}", f"u{i % 30}", f"text {i}", i, f"h{i % 45}") for i in range(100, 160)], CONTENT)
    base = spark.createDataFrame(store.table.read().collect(), CONTENT)
    got = sorted(map(tuple, store.unknown(rows).select(*rows.columns).collect()))
    assert got == sorted(map(tuple, content.drop_known_content(rows, base).select(*rows.columns).collect()))
    cols = base.columns
    want = sorted(map(tuple, content.upsert_content(base, rows).select(*cols).collect()))
    for _ in range(2):
        store.upsert(rows)
        assert sorted(map(tuple, store.table.read().select(*cols).collect())) == want
    latest = sorted(map(tuple, content.latest_scrape(store.table.read()).select(*cols).collect()))
    assert sorted(map(tuple, store.latest().select(*cols).collect())) == latest


def test_delete_cascades_through_the_pages_of_removed_sites(spark, pages):
    held = spark.createDataFrame([("c1", 1, "page of c1"), ("c1", 2, "no page of c1"), ("c2", 2, "page of c2")], PAGES)
    held = BucketTable.create(held, folder(spark, "held"), ["course_id", "page_id"], parts=4, buckets=2)
    for _ in range(2):
        gone = spark.createDataFrame([("c1",)], "course_id string")
        state.delete_stored({"pages": pages, "held": held}, gone, through_pages=["held"])
        assert contents(held) == [("c1", 2, "no page of c1"), ("c2", 2, "page of c2")]
        assert {c for c, _, _ in contents(pages)} == {"c0", "c2"}
