"""File sinks: part files of an export, read in name order, are exactly the rendered document."""

import glob
import os
import uuid

from pyspark.sql import functions as F

from sitelore.operators import documents as docs
from sitelore.plans import catalog
from sitelore.session import scratch_path
from sitelore.sources import files

SF = "/root/testdata/sf0.001"


def test_exports_concatenate_in_order(spark):
    lines = catalog.all_documents(spark, SF)
    blocks = docs.render_documents(lines)
    path = scratch_path(spark, "test-exports")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep 8 range partitions → several parts per file
    try:
        files.write_exports(blocks, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    expected = {}
    for r in blocks.orderBy("course_id", "filename", "sec", "item").collect():
        expected.setdefault((r["course_id"], r["filename"]), []).append(r["text"])
    multi_part = 0
    for (course, fname), texts in expected.items():
        parts = sorted(glob.glob(os.path.join(path, f"course_id={course}", f"filename={fname}", "part-*")))
        multi_part += len(parts) > 1
        content = "".join(open(p, encoding="utf-8").read() for p in parts)
        assert content == "\n".join(texts) + "\n"
    assert multi_part > 0  # at least one document really was written by several tasks
    listing = {(r["course_id"], r["filename"]): r["size_bytes"] for r in files.list_exports(spark, path).collect()}
    assert listing == {k: len(("\n".join(v) + "\n").encode()) for k, v in expected.items()}


def test_raw_roundtrip_keeps_metadata(spark):
    t = catalog.tables(spark, SF)
    c = catalog.fingerprinted(spark, SF)
    path = scratch_path(spark, "test-raw")
    files.write_raw(c, path)
    back = files.read_raw(spark, path)
    assert back.count() == t["content"].count()
    row = back.filter(F.col("page_id") == 1).first()
    assert row["metadata"]["url"].startswith("https://site1.example.edu/p/")
    assert len(row["metadata"]["content_hash"]) == 64


def test_second_write_keeps_the_first(spark):
    rows = [("a", 1, "u1", "one", "h1"), ("a", 2, "u2", "two", "h2"), ("a", 1, "u1", "new", "h3")]
    path, done = scratch_path(spark, "test-raw-twice"), scratch_path(spark, "test-processed-twice")
    for r in rows:
        df = spark.createDataFrame([r], "course_id string, page_id bigint, url string, markdown string, content_hash string")
        files.write_raw(df, path)
        files.write_processed(df.select("course_id", "page_id", F.struct(F.col("markdown").alias("title")).alias("structured")), done)
    back = {r["page_id"]: r["metadata"]["content_hash"] for r in files.read_raw(spark, path).collect()}
    assert back == {1: "h3", 2: "h2"}
    records = files.read_processed(spark, done, "struct<title:string>").collect()
    assert {r["page_id"]: r["structured"]["title"] for r in records} == {1: "new", 2: "two"}


def test_sites_are_written_by_many_tasks_and_few_files(spark):
    rows = spark.range(400).selectExpr("concat('c', id % 40) AS course_id", "id AS page_id", "struct('t' AS title) AS structured")
    hot = spark.range(1000, 1400).selectExpr("'hot' AS course_id", "id AS page_id", "struct('t' AS title) AS structured")
    path = scratch_path(spark, f"test-processed-files-{uuid.uuid4().hex}")
    files.write_processed(rows.unionAll(hot), path)
    names = glob.glob(os.path.join(path, "course_id=*", "part-*"))
    tasks = {os.path.basename(n).split("-")[1] for n in names}
    assert len(tasks) > 1 and len(names) <= 41 + 8
    assert len([n for n in names if "course_id=hot" in n]) > 1
    assert files.read_processed(spark, path, "struct<title:string>").count() == 800


BLOCK = "course_id string, filename string, sec bigint, item bigint, text string"


def _texts(path):
    """Each document's bytes, its part files in name order."""
    names = sorted(glob.glob(os.path.join(glob.escape(path), "course_id=*", "filename=*", "part-*")))
    return {os.path.dirname(n)[len(path) + 1:]: b"".join(open(m, "rb").read() for m in names if os.path.dirname(m) == os.path.dirname(n))
            for n in names}


def _many_documents(spark):
    """600 documents of two blocks in 200 sites, and a folder for them."""
    blocks = spark.range(1200).selectExpr("concat('c', (id % 200)) AS course_id", "concat('d', (id % 600), '.md') AS filename",
                                          "0L AS sec", "id AS item", "concat('text ', id) AS text")
    return blocks, scratch_path(spark, f"test-exports-many-{uuid.uuid4().hex}")


def _tasks_of(spark, action):
    """What ``action`` returns, and how many tasks it took."""
    group = f"tasks-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = action()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    seen = spark.sparkContext.statusTracker()
    stages = {k for j in seen.getJobIdsForGroup(group) for k in seen.getJobInfo(j).stageIds}
    return out, sum(info.numTasks for k in stages if (info := seen.getStageInfo(k)))


def test_many_documents_are_written_by_few_processes(spark):
    blocks, path = _many_documents(spark)

    def processes():
        with open("/proc/stat") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("processes"))

    before = processes()
    files.write_exports(blocks, path)
    assert processes() - before < 600  # Hadoop's local file system starts several for every file
    lines, tasks = _tasks_of(spark, lambda: files.read_exports(spark, path).count())
    assert lines == 1200 and 0 < tasks < 150  # not one for each site and for a few files


def test_mounted_exports_are_those_of_sparks_writer(spark, monkeypatch):
    odd = "a b/c:d%e'f#[x]{y}\\z=é"
    rows = [("a", "one.md", 0, 0, "x"), ("a", "one.md", 0, 1, "y\r\nz\rw"), ("a", "one.md", 1, 0, ""), ("a", "two.md", 0, 0, None),
            ("a", "two.md", 0, 1, "\ufeffé"), (odd, odd, 0, 0, "odd"), (None, "n.md", 0, 0, "null"), ("", "e.md", 0, 0, "empty"),
            ("7", "007", 0, 0, "digits"), ("b", None, 0, 0, "no name"), ("b", "", 0, 1, "empty name"),
            ("bom", "f", 0, 0, "\ufefffirst\n"), ("long", "f", 0, 0, "x" * 3_000_000 + "\r\n" + "y" * 1_048_572 + "\r\nz")]
    blocks = spark.createDataFrame(rows, BLOCK)
    seen = []
    for mounted in (files._mounted, lambda s, p: None):
        monkeypatch.setattr(files, "_mounted", mounted)
        path = scratch_path(spark, f"test-exports-{uuid.uuid4().hex}")
        files.write_exports(blocks, path)
        local = path.removeprefix("file://")
        seen.append((_texts(local), sorted(map(str, files.list_exports(spark, path).collect())),
                     sorted(map(str, files.read_exports(spark, path).collect()))))
        assert not glob.glob(os.path.join(local, ".exports-*"))
    assert seen[0] == seen[1]
    assert seen[0][0]["course_id=a/filename=one.md"] == b"x\ny\r\nz\rw\n\n"
    assert len(seen[0][0]) == 9


def test_a_document_is_replaced_whole_and_others_stay(spark):
    path = scratch_path(spark, f"test-exports-again-{uuid.uuid4().hex}")
    first = spark.range(4000).selectExpr("'a' AS course_id", "concat('d', id % 2) AS filename", "0L AS sec", "id AS item", "'old' AS text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files.write_exports(first, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(glob.glob(os.path.join(path, "course_id=a", "filename=d0", "part-*"))) > 1
    files.write_exports(spark.createDataFrame([("a", "d0", 0, 0, "new"), ("b", "d0", 0, 0, "new")], BLOCK), path)
    assert _texts(path) == {"course_id=a/filename=d0": b"new\n", "course_id=b/filename=d0": b"new\n",
                            "course_id=a/filename=d1": b"old\n" * 2000}
    was = _texts(path)
    failing = spark.range(100).selectExpr("'a' AS course_id", "concat('d', id % 3) AS filename", "0L AS sec", "id AS item",
                                          "CASE WHEN id = 99 THEN raise_error('broken') ELSE 'new' END AS text")
    try:
        files.write_exports(failing, path)
        raise AssertionError("the write should fail")
    except Exception as e:
        assert "broken" in str(e)
    assert _texts(path) == was and not glob.glob(os.path.join(path, ".exports-*"))


def test_many_documents_are_listed_by_few_tasks(spark):
    blocks, path = _many_documents(spark)
    files.write_exports(blocks, path)
    found, tasks = _tasks_of(spark, lambda: files.list_exports(spark, path).collect())
    assert len(found) == 600 and 0 < tasks < 150  # not one for each site and for a few files
    assert sum(r["size_bytes"] for r in found) == sum(map(len, _texts(path).values()))


def test_listed_names_are_text(spark, monkeypatch):
    for mounted in (files._mounted, lambda s, p: None):
        monkeypatch.setattr(files, "_mounted", mounted)
        path = scratch_path(spark, f"test-exports-names-{uuid.uuid4().hex}")
        files.write_exports(spark.createDataFrame([("007", "1", 0, 0, "x"), (None, "", 0, 0, "xy")], BLOCK), path)
        assert [(r["course_id"], r["filename"], r["size_bytes"]) for r in files.list_exports(spark, path).collect()] == [
            (None, None, 3), ("007", "1", 2)]
