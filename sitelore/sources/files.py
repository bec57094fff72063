"""File sinks and listings: raw scrapes, processed records and export documents per site.

Everything is written with ``partitionBy('course_id', ...)`` so one site is a folder. Raw and
processed pages are appended and read back as the latest of each page, so a later write of some
pages keeps the others; exports replace the documents they touch (dynamic partition overwrite).
Listings read only file paths and sizes (``binaryFile`` without its ``content`` column).

Exports are a folder and a file per document. In folders that driver and executors mount (``file:``) tasks
open, move and list those files themselves: Hadoop's local file system starts five processes per file to set its mode,
and Spark's commit and file index go through every folder on the driver.
"""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.functions import rules
from sitelore.session import cut_lineage


def _append_pages(pages: DataFrame, path: str) -> None:
    """Tasks write ranges of (site, page): a small site is one file, a site of more than a range is several tasks' work,
    so files are at most as many as sites and tasks together. The number of tasks is given, since opening files takes
    the time and ranges merged by bytes would have one task open those of many small sites."""
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (pages.withColumn("written_at", F.current_timestamp().cast("string"))
        .repartitionByRange(tasks, "course_id", "page_id").sortWithinPartitions("course_id", "page_id")
        .write.mode("append").partitionBy("course_id").json(path))


def _latest_pages(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The last written row of each page (a retried write repeats its rows)."""
    fields = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.schema(f"page_id bigint, {fields}, written_at string, course_id string").json(path)
    return rows.groupBy("course_id", "page_id").agg(F.max(F.struct("written_at", *columns)).alias("_r")).select(
        "course_id", "page_id", *[F.col(f"_r.{c}").alias(c) for c in columns])


def write_raw(content: DataFrame, path: str) -> None:
    """Raw scrape per page with its sidecar metadata (url, title, content_type, hash, time).

    ``content`` needs ``course_id, page_id, url, markdown, content_hash`` and may carry
    ``title, content_type, retrieved_at``. The file key is the first 12 hex of md5(url).
    """
    cols = set(content.columns)
    meta = F.to_json(F.struct(
        F.col("url"),
        (F.col("title") if "title" in cols else F.lit(None).cast("string")).alias("title"),
        (F.col("content_type") if "content_type" in cols else F.lit(None).cast("string")).alias("content_type"),
        F.col("content_hash"),
        (F.col("retrieved_at").cast("string") if "retrieved_at" in cols else F.lit(None).cast("string")).alias("scraped_at"),
    ))
    out = content.select("course_id", "page_id", F.substring(F.md5("url"), 1, 12).alias("file_key"),
                         "markdown", meta.alias("meta_json"))
    _append_pages(out, path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw files per site with size and metadata; missing or malformed metadata → empty map."""
    raw = _latest_pages(spark, path, ["file_key", "markdown", "meta_json"])
    meta = F.from_json(F.col("meta_json"), "map<string,string>", {"mode": "PERMISSIVE"})
    return raw.select(
        "course_id", "page_id", F.concat(F.col("page_id").cast("string"), F.lit(".md")).alias("filename"),
        F.octet_length(F.coalesce("markdown", F.lit(""))).cast("bigint").alias("size_bytes"),
        F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def write_processed(structured: DataFrame, path: str) -> None:
    """One JSON record per page under its site folder."""
    _append_pages(structured.select("course_id", "page_id", F.to_json("structured").alias("content_json")), path)


def read_processed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = _latest_pages(spark, path, ["content_json"])
    return raw.select("course_id", "page_id", F.from_json("content_json", schema).alias("structured"))


#: The folder of null and empty values, and what folder names hold as %XX, as Spark's file sources write them.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), *b"\"#%'*/:=?[\\]^{\x7f"]}
EXPORT_FILES = "course_id string, filename string, file string, length bigint"


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The name of a folder of the local file system (on a cluster a mounted one); None in any other store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_exports(blocks: DataFrame, path: str) -> None:
    """Write rendered blocks as text files ``course_id=…/filename=…/part-*``.

    Blocks are range-partitioned on ``(course_id, filename, sec, item)`` and sorted inside each
    task, so a large document is spread over several tasks whose part files, in name order,
    concatenate to the document; no task holds more than its range.
    """
    def named(column: str) -> Column:  # never null, else Spark's writer sorts again by folder alone
        return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(NO_VALUE)).alias(column)

    ordered = blocks.select(named("course_id"), named("filename"), "sec", "item", "text").repartitionByRange(
        "course_id", "filename", "sec", "item").sortWithinPartitions("course_id", "filename", "sec", "item")
    root = _mounted(blocks.sparkSession, path)
    if root:
        _write_mounted(ordered.select("course_id", "filename", F.col("text").cast("binary")), root)
    else:
        (ordered.select("course_id", "filename", "text").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("course_id", "filename").text(path))


def _write_mounted(ordered: DataFrame, root: str) -> None:
    """Tasks write their documents into a hidden folder of their attempt and return what they wrote; when all have ended,
    tasks dealt out by document take away its old files and move its new ones in. A task that runs again does no harm: what
    another attempt wrote is not moved, what was moved stays."""
    spark, name = ordered.sparkSession, uuid.uuid4().hex
    staging = f"{root}/.exports-{name}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, document, out, n = TaskContext.get(), None, None, 0
        own = f"{task.partitionId()}-{task.taskAttemptId()}"
        try:
            for batch in batches:
                written = []
                for start in range(0, batch.num_rows, 256):
                    for course, filename, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                        if (course, filename) != document:
                            if out:
                                out.close()
                            else:
                                os.makedirs(f"{staging}/{own}")
                            document, n = (course, filename), n + 1
                            out = open(f"{staging}/{own}/{n}", "wb")
                            written.append((f"course_id={course.translate(ESCAPED)}/filename={filename.translate(ESCAPED)}",
                                            f"{own}/{n}", f"part-{task.partitionId():05d}-{name}.txt"))
                        out.write(text or b"")
                        out.write(b"\n")
                yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in written], pa.string()) for i in range(3)],
                                                 names=["folder", "staged", "part"])
        finally:
            if out:
                out.close()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, parts in zip(*(c.to_pylist() for c in batch.columns)):
                to = f"{root}/{folder}"
                os.makedirs(to, exist_ok=True)
                for old in set(os.listdir(to)) - {p["part"] for p in parts}:
                    with contextlib.suppress(FileNotFoundError):  # another attempt was first
                        if os.path.isdir(f"{to}/{old}"):
                            shutil.rmtree(f"{to}/{old}")
                        else:
                            os.remove(f"{to}/{old}")
                for p in parts:
                    try:
                        os.rename(f"{staging}/{p['staged']}", f"{to}/{p['part']}")
                    except FileNotFoundError:
                        if not os.path.exists(f"{to}/{p['part']}"):
                            raise
            yield batch.select(["folder"])

    os.makedirs(staging)
    try:
        written = cut_lineage(ordered.mapInArrow(write, "folder string, staged string, part string"), name="exports")
        (written.repartition(_tasks(spark), "folder").groupBy("folder").agg(F.collect_list(F.struct("staged", "part")).alias("parts"))
            .mapInArrow(move, "folder string").write.format("noop").mode("overwrite").save())
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def _mounted_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file of an export: the driver lists the sites, tasks list the folders of each."""
    sites = [(e.name,) for e in os.scandir(root) if e.name.startswith("course_id=")]

    def value(folder: str) -> str | None:
        text = re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), folder.partition("=")[2])
        return None if text == NO_VALUE else text

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for site in batch.column(0).to_pylist():
                found = [(value(site), value(folder.name), file.path, file.stat().st_size)
                         for folder in os.scandir(f"{root}/{site}") if folder.name.startswith("filename=")
                         for file in os.scandir(folder.path) if file.is_file() and file.name[0] not in "._"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], kind) for i, kind in enumerate([pa.string()] * 3 + [pa.int64()])],
                    names=["course_id", "filename", "file", "length"])

    return spark.createDataFrame(sites, "site string").mapInArrow(listed, EXPORT_FILES)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """The lines of every file: ``value, course_id, filename``."""
    root = _mounted(spark, path)
    if not root:
        return spark.read.schema("value string, course_id string, filename string").text(path)

    def lines(file: str) -> Iterator[list[bytes]]:
        """Lists of lines, which end with \\n, \\r or \\r\\n as for Spark's reader; a byte order mark at the start is none of them."""
        with open(file, "rb") as f:
            rest = f.read(3)
            rest = b"" if rest == b"\xef\xbb\xbf" else rest
            while chunk := f.read(1 << 20):
                rest += chunk
                # a \r at the end may be half of \r\n
                end = max(rest.rfind(b"\n"), rest.rfind(b"\r", 0, len(rest) - 1)) + 1
                yield rest[:end].splitlines()
                rest = rest[end:]
            yield rest.splitlines()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for course, filename, file in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for values in lines(file):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values, pa.binary()).view(pa.string()), pa.array([course] * len(values), pa.string()),
                         pa.array([filename] * len(values), pa.string())], names=["value", "course_id", "filename"])

    return _mounted_files(spark, root).repartition(_tasks(spark), "file").mapInArrow(
        read, "value string, course_id string, filename string")


def list_exports(spark: SparkSession, path: str) -> DataFrame:
    """Files per site (sorted by name) with size, type and size in KB (one decimal)."""
    root = _mounted(spark, path)
    files = _mounted_files(spark, root) if root else spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary, course_id string, filename string").option(
        "recursiveFileLookup", "false").load(path)
    sized = files.groupBy("course_id", "filename").agg(F.sum("length").cast("bigint").alias("size_bytes"))
    return sized.select(
        "course_id", "filename", "size_bytes", rules.export_file_type(F.col("filename")).alias("file_type"),
        F.round(F.col("size_bytes") / 1024.0, 1).alias("size_kb"),
    ).orderBy("course_id", "filename")
