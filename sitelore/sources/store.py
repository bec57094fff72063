"""Stored tables: bucketed by their cluster columns, changed by copy-on-write of hash partitions.

A table is a Spark data-source table (Parquet) with ``parts`` hash partitions, each bucketed and sorted by the
cluster columns. Reads by those columns need no exchange of the stored side, and a change rewrites only the
partitions that hold changed keys (dynamic partition overwrite from a written copy), so files of the others stay as they
are. Every change is idempotent: applied again, after it died at any point, it gives the same table.

The catalog entry belongs to the session's catalog; the files lie under ``path`` on shared storage, and ``BucketTable.open``
makes an entry for files that another application has written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.session import cut_lineage

PART = "_part"


class BucketTable:
    """Rows unique by ``keys``; ``cluster`` (a prefix or part of the keys) places them."""

    def __init__(self, spark: SparkSession, name: str, path: str, keys: Sequence[str], cluster: Sequence[str], parts: int):
        self.spark, self.name, self.path = spark, name, path.rstrip("/")
        self.keys, self.cluster, self.parts = list(keys), list(cluster), parts

    # ------------------------------------------------------------ making and reading
    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], cluster: Sequence[str] | None = None,
               parts: int = 8, buckets: int | None = None, name: str | None = None) -> BucketTable:
        """Write ``rows`` (unique by ``keys``) as a new table. ``buckets``: by default as many as shuffle partitions; with
        fewer, Spark rather deals out the stored side of a join than the other one."""
        buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        table = cls(rows.sparkSession, name or f"stored_{uuid.uuid4().hex}", path, keys, cluster or keys, parts)
        # a task of this exchange holds one bucket number, so a partition has one file a bucket
        placed = rows.withColumn(PART, table.part()).repartition(buckets, *table.cluster)
        (placed.write.format("parquet").partitionBy(PART).bucketBy(buckets, *table.cluster).sortBy(*table.cluster)
         .option("path", table.path).saveAsTable(table.name))
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: str, keys: Sequence[str], cluster: Sequence[str] | None = None,
             parts: int = 8, buckets: int = 8, name: str | None = None) -> BucketTable:
        """A table over files that ``create`` wrote with the same parameters."""
        table = cls(spark, name or f"stored_{uuid.uuid4().hex}", path, keys, cluster or keys, parts)
        by = ", ".join(f"`{c}`" for c in table.cluster)
        location = table.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table.name} ({schema}, {PART} BIGINT) USING PARQUET PARTITIONED BY ({PART}) "
                  f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{location}'")
        spark.catalog.recoverPartitions(table.name)
        return table

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.cluster), F.lit(self.parts))

    def _rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        return self._rows().drop(PART)

    # ------------------------------------------------------------ changes
    def _touched(self, keyed: DataFrame) -> list[int]:
        """Partitions of ``keyed`` rows: at most ``parts`` numbers."""
        return sorted(r[PART] for r in keyed.select(PART).distinct().collect())

    def _rewrite(self, touched: Sequence[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace partitions by what ``change`` makes of their rows (with ``_part``)."""
        if not touched:
            return
        columns = self._rows().columns
        after = cut_lineage(change(self._rows().where(F.col(PART).isin(list(touched)))).select(*columns), name="rewritten")
        # a session of its own, so the caller's settings stay as they are
        writer = self.spark.newSession()
        writer.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        left = set(self._touched(after))
        if left:
            writer.read.parquet(*after.inputFiles()).select(*columns).repartition(self._buckets(), *self.cluster).write.insertInto(
                self.name, overwrite=True)
        for empty in [p for p in touched if p not in left]:
            writer.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({PART}={int(empty)})")
            self._remove(empty)
        self.spark.catalog.refreshTable(self.name)

    def _buckets(self) -> int:
        return int(next(r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()
                        if r["col_name"] == "Num Buckets"))

    def _remove(self, part: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={int(part)}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def upsert(self, new: DataFrame, latest: Sequence[str] = ()) -> None:
        """Insert or replace by key; among new rows of one key the one with the largest ``latest`` wins."""
        names = [c for c in self.read().columns]
        rest = [c for c in names if c not in self.keys]
        if latest:
            new = new.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*latest)).alias("_n")).select(
                *self.keys, *[F.col(f"_n.{c}").alias(c) for c in rest])
        new = cut_lineage(new.select(*names).withColumn(PART, self.part()), name="upserted")

        def merged(old: DataFrame) -> DataFrame:
            if self.keys == self.cluster:
                return old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)
            # only rows that share the cluster columns with a new one are dealt out by the whole key
            near = new.select(*self.cluster).distinct()
            apart = old.join(near, self.cluster, "left_anti")
            close = old.join(near, self.cluster, "left_semi").join(new.select(*self.keys), self.keys, "left_anti")
            return apart.unionByName(close).unionByName(new)

        self._rewrite(self._touched(new), merged)

    def delete(self, match: DataFrame, on: Sequence[str] | None = None) -> None:
        """Remove the rows whose columns ``on`` (the keys unless given) are in ``match``."""
        on = list(on or self.keys)
        match = match.select(*on).distinct()
        gone = self._rows().join(match, on, "left_semi")
        self._rewrite(self._touched(gone), lambda old: old.join(match, on, "left_anti"))
