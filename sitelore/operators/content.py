"""Scraped content: fingerprints, cache and duplicate splits, latest versions, upserts, timelines.

Content schema: ``page_id, course_id, url, markdown, retrieved_at`` (+ ``content_hash``).
Splits against the stored content are semi/anti joins that read only the key columns of the
store (column pruning keeps ``markdown`` out of the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.sources.store import BucketTable


def content_fingerprint(content: DataFrame) -> DataFrame:
    """``content_hash`` = sha256 of the UTF-8 markdown (hex); ``file_key`` = first 12 hex of md5(url)."""
    return content.withColumn("content_hash", F.sha2(F.col("markdown"), 256)).withColumn(
        "file_key", F.substring(F.md5(F.col("url")), 1, 12))


def cache_split(frontier: DataFrame, content: DataFrame) -> DataFrame:
    """``frontier`` with ``hit``: a page whose URL already has stored content (any site) is not re-scraped. One left
    join with the stored URLs."""
    known = content.select("url").distinct().withColumn("hit", F.lit(True))
    return frontier.join(known, "url", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def drop_known_content(new: DataFrame, content: DataFrame) -> DataFrame:
    """Skip new rows whose ``(url, content_hash)`` is already stored."""
    return new.join(content.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def latest_scrape(content: DataFrame) -> DataFrame:
    """Newest ``retrieved_at`` per URL (tie: higher ``page_id``), as a partial aggregate."""
    cols = [c for c in content.columns if c != "url"]
    latest = F.max_by(F.struct(*cols), F.struct("retrieved_at", "page_id"))
    return content.groupBy("url").agg(latest.alias("_l")).select("url", *[F.col(f"_l.{c}").alias(c) for c in cols])


def upsert_content(base: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by unique key ``(url, content_hash)``: a new row wins over a stored one, and among new
    rows the later one (``retrieved_at``, then ``page_id``) wins."""
    cols = [c for c in base.columns if c not in ("url", "content_hash")]
    both = base.withColumn("_src", F.lit(0)).unionByName(new.select(*base.columns).withColumn("_src", F.lit(1)))
    winner = F.max_by(F.struct(*cols), F.struct("_src", "retrieved_at", "page_id"))
    return both.groupBy("url", "content_hash").agg(winner.alias("_w")).select(
        "url", "content_hash", *[F.col(f"_w.{c}").alias(c) for c in cols])


class ContentStore:
    """Stored content, unique by ``(url, content_hash)`` and bucketed by ``url``: no operation shuffles the stored texts.

    What is found by URL needs no exchange of the store at all; what is found by the whole key deals out only the
    stored rows (without texts) that share a URL with a new one.
    """

    def __init__(self, table: BucketTable):
        self.table = table

    @classmethod
    def create(cls, content: DataFrame, path: str, parts: int = 8, buckets: int | None = None) -> ContentStore:
        """A store of the winning row of each key of ``content`` (later ``retrieved_at``, then larger ``page_id``)."""
        rest = [c for c in content.columns if c not in ("url", "content_hash")]
        rows = content.groupBy("url", "content_hash").agg(
            F.max_by(F.struct(*rest), F.struct("retrieved_at", "page_id")).alias("_w")).select(
            *[c if c in ("url", "content_hash") else F.col(f"_w.{c}").alias(c) for c in content.columns])
        return cls(BucketTable.create(rows, path, ["url", "content_hash"], ["url"], parts, buckets))

    def split(self, frontier: DataFrame) -> DataFrame:
        """``cache_split`` against the store."""
        return cache_split(frontier, self.table.read())

    def unknown(self, new: DataFrame) -> DataFrame:
        """``drop_known_content`` against the store."""
        known = self.table.read().select("url", "content_hash").join(new.select("url").distinct(), "url", "left_semi")
        return new.join(known, ["url", "content_hash"], "left_anti")

    def latest(self) -> DataFrame:
        """``latest_scrape`` of the store: the rows of a URL lie together, so no text is shuffled."""
        return latest_scrape(self.table.read())

    def upsert(self, new: DataFrame) -> None:
        """``upsert_content`` into the store: only hash partitions with a new row are rewritten."""
        self.table.upsert(new, ["retrieved_at", "page_id"])


def content_timeline(content: DataFrame) -> DataFrame:
    """Content of each site in retrieval order (global range sort; no single-task gather)."""
    return content.orderBy("course_id", "retrieved_at", "page_id")
