"""Streaming jobs equal their batch twins."""

import datetime
import uuid

import pytest

from sitelore.operators import content, frontier, state
from sitelore.plans import catalog
from sitelore.streaming import jobs
from sitelore.streaming.changes import ChangeLog

SF = "/root/testdata/sf0.001"


def _set(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_discover_equals_batch(spark):
    t = catalog.tables(spark, SF)
    streamed = catalog.QUERIES["stream_discover"](spark, SF)
    batch = frontier.discover_pages(t["links"], t["courses"])
    cols = ["course_id", "page_id", "url", "canonical", "title", "content_type"]
    assert _set(streamed, cols) == _set(batch, cols)


def test_stream_ingest_equals_batch(spark):
    t = catalog.tables(spark, SF)
    streamed = catalog.QUERIES["stream_ingest"](spark, SF)
    batch = content.content_fingerprint(t["content"].filter("markdown <> ''")).select("url", "content_hash").distinct()
    assert _set(streamed, ["url", "content_hash"]) == _set(batch, ["url", "content_hash"])


def test_stream_progress_equals_batch(spark):
    t = catalog.tables(spark, SF)
    streamed = catalog.QUERIES["stream_progress"](spark, SF)
    batch = state.job_summary(t["job_events"])
    cols = ["job_id", "pages_discovered", "pages_scraped", "pages_failed", "pages_processed", "files_generated"]
    assert _set(streamed, cols) == _set(batch, cols)


LINKS = "course_id string, ord bigint, url string, title string"


def _arrive(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _folders(spark, name):
    from sitelore.session import scratch_path
    return [scratch_path(spark, f"test-{name}-{uuid.uuid4().hex}-{x}") for x in ("in", "out", "ckpt")]


COURSES = [("a", "https://s.edu"), ("b", "https://s.edu")]
ARRIVALS = [[("a", 9, "https://s.edu/x", "late position")],
            [("a", 1, "https://s.edu/x/", "early position"), ("a", 2, "https://s.edu/y", "y")],
            [("a", 4, "https://s.edu/x", "again"), ("b", 1, "https://s.edu/x", "other site"), ("a", 3, "https://s.edu/y/", "y2")]]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_first_link_does_not_depend_on_arrival(spark, order):
    src, sink, ckpt = _folders(spark, "arrival")
    _arrive(spark, src, LINKS, [ARRIVALS[k] for k in order])
    courses = spark.createDataFrame(COURSES, "course_id string, url string")
    jobs.stream_discover(spark, src, LINKS, sink, ckpt, max_files=1).awaitTermination()
    got = jobs.discovered_from_stream(spark, sink, courses).collect()
    assert sorted((r["course_id"], r["page_id"], r["title"]) for r in got) == [
        ("a", 1, "early position"), ("a", 2, "y"), ("b", 1, "other site")]
    batch = frontier.discover_pages(spark.read.parquet(src), courses).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_late_smaller_position_is_a_correction_row(spark):
    src, sink, ckpt = _folders(spark, "correction")
    _arrive(spark, src, LINKS, ARRIVALS[:2])
    jobs.stream_discover(spark, src, LINKS, sink, ckpt, max_files=1).awaitTermination()
    log = jobs.first_links(spark, sink)
    rows = [[(r.course_id, r.canonical, r.ord) for r in spark.read.parquet(p).collect()] for _, p in log.batches()]
    assert [sorted(r) for r in rows] == [[("a", "https://s.edu/x", 9)], [("a", "https://s.edu/x", 1), ("a", "https://s.edu/y", 2)]]
    # more arrives after a compaction and a restart: the state knows what came before
    assert log.compact() == 2 and log.batches() == []
    _arrive(spark, src, LINKS, [[("a", 5, "https://s.edu/x", "later"), ("a", 0, "https://s.edu/y", "corrected")]])
    jobs.stream_discover(spark, src, LINKS, sink, ckpt).awaitTermination()
    assert sorted((r.canonical, r.ord) for r in log.read().collect()) == [("https://s.edu/x", 1), ("https://s.edu/y", 0)]


CONTENT = "page_id bigint, course_id string, url string, markdown string, retrieved_at timestamp_ntz"


def _page(i, url, text, minute):
    return i, "c", url, text, datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def test_ingest_skips_stored_content_and_repeated_files(spark):
    src, sink, ckpt = _folders(spark, "ingest")
    stored = content.content_fingerprint(spark.createDataFrame([_page(0, "u1", "old", 0)], CONTENT))
    _arrive(spark, src, CONTENT, [[_page(1, "u1", "old", 1), _page(2, "u1", "new", 2), _page(3, "u2", "", 3), _page(4, "u2", None, 3)],
                                  [_page(5, "u1", "new", 4), _page(6, "u3", "old", 5)]])
    jobs.stream_ingest(spark, src, CONTENT, sink, ckpt, stored=stored, max_files=1).awaitTermination()
    assert _set(spark.read.parquet(sink), ["page_id", "url", "markdown"]) == [(2, "u1", "new"), (6, "u3", "old")]
    # the same files again, under other names, and one new page: a restart goes on from its state
    _arrive(spark, src, CONTENT, [[_page(2, "u1", "new", 2), _page(6, "u3", "old", 5)], [_page(7, "u4", "x", 6)]])
    jobs.stream_ingest(spark, src, CONTENT, sink, ckpt, stored=stored, max_files=1).awaitTermination()
    assert _set(spark.read.parquet(sink), ["page_id"]) == [(2,), (6,), (7,)]


def test_ingest_state_expires_with_the_watermark(spark):
    src, sink, ckpt = _folders(spark, "expiry")
    _arrive(spark, src, CONTENT, [[_page(1, "u1", "x", 0)], [_page(2, "u1", "x", 1)], [_page(3, "u2", "y", 600)],
                                  [_page(4, "u3", "z", 601)], [_page(5, "u4", "late", 2)], [_page(6, "u1", "x", 602)]])
    jobs.stream_ingest(spark, src, CONTENT, sink, ckpt, watermark="10 minutes", max_files=1).awaitTermination()
    # 2 repeats 1 in time; 5 is older than the watermark; 6 repeats a key that has expired
    assert _set(spark.read.parquet(sink), ["page_id"]) == [(1,), (3,), (4,), (6,)]


EVENTS = "event_id bigint, job_id bigint, course_id string, event string"


def test_progress_writes_only_changed_jobs_and_compacts(spark):
    src, sink, ckpt = _folders(spark, "progress")
    _arrive(spark, src, EVENTS, [[(1, 1, "a", "scraped"), (2, 2, "a", "scraped")], [(3, 2, "a", "failed")], [(4, 2, "a", "scraped")]])
    jobs.stream_progress(spark, src, EVENTS, sink, ckpt, max_files=1, compact_every=100).awaitTermination()
    log = jobs.progress_log(spark, sink)
    written = [sorted(r.job_id for r in spark.read.parquet(p).collect()) for _, p in log.batches()]
    assert written == [[1, 2], [2], [2]]
    want = [(1, 1, 0), (2, 2, 1)]
    columns = ["job_id", "pages_scraped", "pages_failed"]
    assert _set(jobs.read_progress(spark, sink), columns) == want
    # a batch written again counts once, and so does one that a dying compaction left in both places
    number, folder = log.batches()[-1]
    rows = spark.createDataFrame(spark.read.parquet(folder).collect(), jobs.PROGRESS)
    log.append(rows, number)
    assert _set(jobs.read_progress(spark, sink), columns) == want
    assert log.compact() == 3 and _set(jobs.read_progress(spark, sink), columns) == want
    log.append(rows, number)
    assert _set(jobs.read_progress(spark, sink), columns) == want


def test_compaction_rewrites_touched_buckets_only(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "k bigint, v bigint, n bigint", ["k"], ["-n"], buckets=8)
    assert log.read().collect() == [] and log.compact() == 0
    log.append(spark.range(100).selectExpr("id AS k", "id AS v", "0L AS n"), 0)
    assert log.compact() == 1
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "log" / "base").rglob("*.parquet")}
    log.append(spark.createDataFrame([(7, 70, 1)], "k bigint, v bigint, n bigint"), 1)
    assert log.compact() == 1
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "log" / "base").rglob("*.parquet")}
    assert len(set(after.items()) - set(before.items())) == 1 and len(before) == len(after) == 8
    assert sorted((r.k, r.v) for r in log.read().collect()) == sorted((k, 70 if k == 7 else k) for k in range(100))


def test_half_written_batches_are_not_read(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "id bigint", ["id"], ["id"])
    log.append(spark.range(3), 3)
    log.append(spark.range(5), 4)
    (tmp_path / "log" / "changes" / "batch_id=4" / "_SUCCESS").unlink()
    assert log.read().count() == 3
    log.append(spark.range(5), 4)  # the batch is tried again
    assert log.read().count() == 5


def test_streams_leave_the_callers_session_alone(spark):
    src, sink, ckpt = _folders(spark, "conf")
    _arrive(spark, src, EVENTS, [[(1, 1, "a", "scraped")]])
    before = spark.conf.get(jobs.PROVIDER, None)
    jobs.stream_progress(spark, src, EVENTS, sink, ckpt).awaitTermination()
    assert spark.conf.get(jobs.PROVIDER, None) == before
