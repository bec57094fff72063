"""A change log for streaming sinks: what each trigger changed, folded by key, compacted into hash-bucket partitions.

``changes/batch_id=N`` holds the rows that micro-batch N changed, and nothing else; a retried batch replaces its own
folder. ``base`` holds compacted rows in hash-bucket partitions. The current table is the fold of both: per key the
row that ``wins`` (an order that a row carries itself). A fold is idempotent, so a row found in the base and in a change
folder, after a compaction that died half way, counts once, and no step depends on what another has cleaned up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.session import cut_lineage


class ChangeLog:
    """Rows of ``schema`` (DDL) by ``keys``. ``wins``: SQL expressions; per key the row with their smallest values stays."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], wins: Sequence[str],
                 buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.wins, self.buckets = list(keys), list(wins), buckets

    # ------------------------------------------------------------ files
    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[tuple[int, str]]:
        """(number, folder) of the completely written batches, in order."""
        path, fs = self._fs()
        found = [s.getPath() for s in fs.globStatus(path(f"{self.path}/changes/batch_id=*")) or []]
        return sorted((int(p.getName().split("=")[1]), p.toString()) for p in found if fs.exists(path(p, "_SUCCESS")))

    def base_buckets(self) -> list[str]:
        path, fs = self._fs()
        return [s.getPath().toString() for s in fs.globStatus(path(f"{self.path}/base/bucket=*")) or []]

    # ------------------------------------------------------------ rows
    def fold(self, rows: DataFrame) -> DataFrame:
        """Per key the winning row, by partial aggregation."""
        rest = [c for c in rows.columns if c not in self.keys]
        order = F.struct(*[F.expr(w).alias(f"o{i}") for i, w in enumerate(self.wins)])
        return rows.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(
            *self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest])

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """The changed rows of a micro-batch; the same batch again replaces them."""
        batch.write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={int(batch_id)}")

    def _stored(self, folders: Sequence[str], base: bool = True) -> DataFrame:
        paths = [*folders, *(self.base_buckets() if base else [])]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The current table."""
        return self.fold(self._stored([p for _, p in self.batches()]))

    def compact(self) -> int:
        """Fold all complete batches into the base, rewriting only the buckets that they touch; returns how many batches
        were folded. The folders go after the base is written."""
        done = [p for _, p in self.batches()]
        if not done:
            return 0
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        changed = cut_lineage(self.fold(self._stored(done, base=False)).withColumn("bucket", bucket), name="changes")
        touched = {f"bucket={r['bucket']}" for r in changed.select("bucket").distinct().collect()}  # at most ``buckets``
        old = [p for p in self.base_buckets() if p.rsplit("/", 1)[1] in touched]
        if old:
            stored = self.spark.read.schema(self.schema).parquet(*old)
            changed = cut_lineage(self.fold(changed.drop("bucket").unionByName(stored)).withColumn("bucket", bucket),
                                  name="compacted")
        (changed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(f"{self.path}/base"))
        path, fs = self._fs()
        for folder in done:
            fs.delete(path(folder), True)
        return len(done)
