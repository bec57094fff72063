"""Token counts as delta-maintained rollups: additive totals by source, language and tokenizer version.

A batch is a table of signed deltas: an insert adds a document's counts, a delete takes them away, a revision does both
(old counts out, new counts in). Deltas are summed per key before the shuffle and written as an attempt of the batch, a
folder of its own that counts once Spark's committer has marked it complete. Of a batch's complete attempts the last one
counts, so a retried batch counts once, and a retry that dies leaves the attempt before it. ``compact`` folds batches
into one attempt that names the last batch it holds. Totals are the sum over all that counts.

Defined results: null source or language is a key of its own; a null text has 0 tokens and counts as a document; a null
doc_id counts as a document; repeated rows count each; rows that share a doc_id but not their text are told apart by
the text; an empty batch changes nothing; keys whose documents are all deleted are left out of the totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .texts import byte_columns, words_of
from .tokenizers import default_path, word_ids

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "chars")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def counted(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """doc_id, version (a hash of the text, or the column of that name), source, lang, tokenizer, tokens, chars and sign (1
    if ``docs`` has none) of every row.

    ``tokenizer``: ``words/1`` (white-space words, built-in) or ``word_bpe_49k/1`` (ids of the public vocabulary).
    """
    sign = F.col("sign").cast("long") if "sign" in docs.columns else F.lit(1).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    version = F.col("version").cast("long") if "version" in docs.columns else F.xxhash64(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version.alias("version"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.char_length(text).cast("long").alias("chars"),
                       sign.alias("sign"), text.alias("text"))
    if tokenizer == "words/1":
        out = rows.withColumn("tokens", F.size(words_of(F.col("text"))).cast("long")).drop("text")
    elif tokenizer == "word_bpe_49k/1":
        path = path or default_path()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = word_ids(path)
            for batch in batches:
                data, offsets = byte_columns(batch.column(6))
                n = [len(encode(data[a:b].tobytes())) // 4 for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(n, pa.int64())],
                                                 names=["doc_id", "version", "source", "lang", "chars", "sign", "tokens"])

        out = rows.mapInArrow(run, "doc_id long, version long, source string, lang string, chars long, sign long, tokens long")
    else:
        raise ValueError(f"unknown tokenizer version {tokenizer}")
    return out.select("doc_id", "version", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens", "chars", "sign")


def deltas(rows: DataFrame) -> DataFrame:
    """Signed sums of counted rows by key; Spark sums each task's rows before the shuffle, so hot keys are a row a task."""
    return rows.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
                                   F.sum(F.col("sign") * F.col("chars")).alias("chars"))


class Rollup:
    """The rollup table under ``path`` (in storage that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def attempts(self) -> list[tuple[int, int, int, str]]:
        """(last batch that a compaction holds, else 0; batch; attempt; folder) of all complete attempts."""
        path, fs = self._fs()
        out = []
        for s in fs.globStatus(path(f"{self.path}/upto=*/batch=*/attempt=*")) or []:
            if fs.exists(path(s.getPath(), "_SUCCESS")):
                upto, batch, attempt = (int(x.split("=")[1]) for x in s.getPath().toString().split("/")[-3:])
                out.append((upto, batch, attempt, s.getPath().toString()))
        return sorted(out)

    def counted_attempts(self) -> list[tuple[int, int, str]]:
        """(first batch, last batch, folder): the last compaction, and the last attempt of every batch after it."""
        done = self.attempts()
        base = max((upto for upto, _, _, _ in done), default=0)
        last = {(upto, batch): folder for upto, batch, _, folder in done}
        return [(0 if upto else batch, upto or batch, folder) for (upto, batch), folder in sorted(last.items())
                if (upto == base and upto) or (not upto and batch > base)]

    def _write(self, upto: int, batch: int, rows: DataFrame) -> None:
        tried = [a for u, b, a, _ in self.attempts() if (u, b) == (upto, batch)]
        # an attempt that died left its folder: its number is taken over
        rows.select(*KEYS, *SUMS).write.mode("overwrite").parquet(
            f"{self.path}/upto={upto}/batch={batch}/attempt={max(tried, default=0) + 1}")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Write a batch's deltas (batches count from 1); the same batch number again replaces them once it is complete."""
        if batch <= max((upto for upto, _, _, _ in self.attempts()), default=0):
            raise ValueError(f"batch {batch} is compacted")
        self._write(0, int(batch), changes)

    def compact(self) -> None:
        """Fold all batches into one folder; theirs, and earlier attempts, are removed after it counts."""
        counted = self.counted_attempts()
        if not counted:
            return
        upto = max(last for _, last, _ in counted)
        old = [folder for _, _, _, folder in self.attempts()]
        if len(counted) > 1 or counted[0][0]:
            self._write(upto, upto, self.totals())
        path, fs = self._fs()
        keep = {folder for _, _, folder in self.counted_attempts()}
        for folder in old:
            if folder not in keep:
                fs.delete(path(folder), True)

    def batches(self) -> DataFrame | None:
        done = [folder for _, _, folder in self.counted_attempts()]
        return self.spark.read.schema(DELTA).parquet(*done) if done else None

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, chars of everything committed."""
        rows = self.batches()
        rows = self.spark.createDataFrame([], DELTA) if rows is None else rows
        return (rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
                .where(" OR ".join(f"{c} <> 0" for c in SUMS)))


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id and version of rows whose whole text a smaller doc_id has too: by 256-bit hash, the smallest by partial
    minimum."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.select("doc_id", F.xxhash64(text).alias("version"), F.sha2(text, 256).alias("h")).where("doc_id IS NOT NULL")
    first = ids.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    return ids.join(first, "h").where("doc_id <> first").select("doc_id", "version").distinct()


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that repeat a line, with each line once and ``version`` of the text before: the revision that
    ``maintained`` counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (docs.withColumn("version", F.xxhash64(text)).withColumn("_lines", F.split(text, "\n")).where(F.size(F.array_distinct("_lines")) < F.size("_lines"))
            .withColumn("text", F.array_join(F.array_distinct("_lines"), "\n")).drop("_lines"))


def maintained(rollup: Rollup, docs: DataFrame, tokenizers: tuple[str, ...] = ("words/1", "word_bpe_49k/1"),
               path: str | None = None) -> DataFrame:
    """Totals after three batches over ``docs``: all are inserted, exact copies are deleted, and documents that stay
    and repeat lines are revised (old counts out, counts of each line once in)."""
    inserted = cut_lineage(reduce(DataFrame.unionAll, [counted(docs, t, path) for t in tokenizers]), name="op1-counts")
    rollup.commit(1, deltas(inserted))
    row = ["doc_id", "version"]
    copies = cut_lineage(exact_copies(docs), name="op1-copies")
    rollup.commit(2, deltas(inserted.join(copies, row, "left_semi").withColumn("sign", F.lit(-1).cast("long"))))
    changed = without_repeated_lines(docs.select("doc_id", "source", "lang", "text")).where("doc_id IS NOT NULL")
    new = reduce(DataFrame.unionAll, [counted(changed, t, path) for t in tokenizers])
    new = cut_lineage(new.join(copies, row, "left_anti"), name="op1-revised")
    old = inserted.join(new.select(*row).distinct(), row, "left_semi").withColumn("sign", F.lit(-1).cast("long"))
    rollup.commit(3, deltas(old.unionByName(new)))
    return rollup.totals()
