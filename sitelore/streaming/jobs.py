"""Incremental jobs with Structured Streaming: ingest, discovery and live job progress.

Each job reads new files from a folder (``readStream`` with an explicit schema), keeps its
state in the checkpoint location (``checkpointLocation`` under the shared folder), and can run
as a continuous query or, for back-fills and tests, with ``trigger(availableNow=True)``.
State lives in RocksDB stores (on disk, checkpointed to the shared folder), so the number of
keys is not bounded by the executors' heap. No job reads its sink.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.operators import content as contentops
from sitelore.operators import frontier
from sitelore.streaming.changes import ChangeLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FIRST_LINK = ("course_id string, canonical string, ord bigint, url string, title string, path string, "
              "url_base string")
PROGRESS = ("job_id bigint, course_id string, pages_discovered bigint, pages_scraped bigint, pages_failed bigint, "
            "pages_processed bigint, files_generated bigint, batch_id bigint")


@contextmanager
def _rocksdb(spark: SparkSession):
    """A query takes its state store from the session when it starts; the caller's setting comes back after that."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _started(writer, spark: SparkSession, checkpoint: str, available_now: bool):
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    with _rocksdb(spark):
        return writer.start()


def _files(spark: SparkSession, source: str, schema: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source)


def stream_ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
                  available_now: bool = True, watermark: str | None = None, stored: DataFrame | None = None,
                  max_files: int | None = None):
    """New content rows → fingerprint → skip what is ``stored`` → drop repeats of ``(url, content_hash)`` → append.

    ``stored`` (``url, content_hash``) is content from before the stream, joined to every micro-batch as
    a static table: a page whose text is already there is skipped. Without ``watermark`` the
    keys seen by the stream are kept forever (exact, state grows with distinct keys); with ``watermark``
    (e.g. ``'1 day'`` on ``retrieved_at``) a key expires when the watermark passes it, and rows later than the
    watermark are dropped. Repeated files bring no rows: their keys are in the state.
    """
    rows = _files(spark, source, schema, max_files)
    # a page without text has failed, like in batch
    fp = contentops.content_fingerprint(rows.filter(F.coalesce("markdown", F.lit("")) != ""))
    if stored is not None:
        fp = fp.join(stored.select("url", "content_hash").distinct(), ["url", "content_hash"], "left_anti")
    if watermark:
        timed = fp.withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
        fp = timed.withWatermark("retrieved_at", watermark).dropDuplicatesWithinWatermark(["url", "content_hash"])
    else:
        fp = fp.dropDuplicates(["url", "content_hash"])
    return _started(fp.writeStream.format("parquet").option("path", sink).outputMode("append"), spark, checkpoint,
                    available_now)


def first_links(spark: SparkSession, sink: str) -> ChangeLog:
    """The sink of ``stream_discover``: per site and canonical URL the link of smallest position, then URL."""
    return ChangeLog(spark, sink, FIRST_LINK, ["course_id", "canonical"], ["ord", "url"])


def stream_discover(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
                    available_now: bool = True, max_files: int | None = None):
    """Links arriving in files → first link per ``(course_id, canonical)`` over all batches.

    The state holds the first link (smallest ``ord``, tie ``url``) of each key. A trigger emits the keys
    that it touches: a new key, or a *correction* when a smaller ``ord`` comes late. The sink is a
    ``ChangeLog`` whose fold is the current first link, so the result equals the batch ``dedupe_links`` for
    any order of arrival, and no trigger reads what earlier ones wrote. Relevance and classification come
    when the log is read (``discovered_from_stream``), after the dedup as in batch. ``max_files``
    bounds the files of a micro-batch; by default it takes all that have arrived.
    """
    prepared = frontier.prepare_frontier(_files(spark, source, schema, max_files))
    log = first_links(spark, sink)
    names = [c.split()[0] for c in FIRST_LINK.split(", ")]
    firsts = frontier.dedupe_links(prepared).select(*names)
    return _started(firsts.writeStream.outputMode("update").foreachBatch(log.append), spark, checkpoint, available_now)


def discovered_from_stream(spark: SparkSession, sink: str, courses: DataFrame) -> DataFrame:
    """Pages from the stream's first links: relevance filter and classification."""
    based = frontier.with_course_base(first_links(spark, sink).read(), courses)
    kept = frontier.classify_links(based.filter(frontier.relevance_flag(based)))
    return kept.select("course_id", F.col("ord").alias("page_id"), "url", "canonical", "title", "content_type")


def progress_log(spark: SparkSession, sink: str) -> ChangeLog:
    """The sink of ``stream_progress``: per job the counters of the last batch that changed them."""
    return ChangeLog(spark, sink, PROGRESS, ["job_id", "course_id"], ["-batch_id"])


def stream_progress(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
                    available_now: bool = True, max_files: int | None = None, compact_every: int = 20):
    """Live counters per job. A trigger writes only the jobs that it changes, with their totals so far (not
    increments), so a retried batch counts once; every ``compact_every`` batches the log is folded
    into its hash-bucket partitions."""
    events = _files(spark, source, schema, max_files)

    def counted(event: str) -> Column:
        return F.count_if(F.col("event") == event)

    counters = events.groupBy("job_id", "course_id").agg(
        counted("discovered").alias("pages_discovered"), counted("scraped").alias("pages_scraped"),
        counted("failed").alias("pages_failed"), counted("processed").alias("pages_processed"),
        counted("generated").alias("files_generated"))
    log = progress_log(spark, sink)

    def changed(batch: DataFrame, batch_id: int) -> None:
        log.append(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)
        if (batch_id + 1) % compact_every == 0:
            log.compact()

    return _started(counters.writeStream.outputMode("update").foreachBatch(changed), spark, checkpoint, available_now)


def read_progress(spark: SparkSession, sink: str) -> DataFrame:
    """The current counters of every job."""
    return progress_log(spark, sink).read().drop("batch_id")
