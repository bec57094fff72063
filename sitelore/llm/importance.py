"""Quality classifier by importance resampling: the ratio of two hashed n-gram generative models, of target texts and of
all raw texts, weighs a document; adding Gumbel noise to the log weight and keeping the largest k draws k documents
without replacement in proportion to their weights (Gumbel top-k).

Both models are counts over all documents in BUCKETS buckets of hashed one- and two-word n-grams, summed in Spark
from one row of counts a task; only their ratio (a fixed size) goes to the tasks. The target is the documents that the
label table calls good; k is a share of the documents, by default that of good ones among the labelled.

Defined results: a null text has no n-grams and weight 0; a null doc_id is scored but never kept; rows that share a
doc_id are scored each and share the noise; ties go to the smaller doc_id; without labels nothing is known: all
weights are 0 and every document is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import rolling
from .repeats import BATCH_BYTES
from .substring_dedup import word_pieces
from .texts import byte_columns, slices

BUCKETS = 1 << 14
SMOOTHING = 1.0


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and every two-word run of a slice, and the row each belongs to."""
    text = data[offsets[0]:offsets[-1]]
    text = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
    values, words, _, _ = word_pieces(text, offsets - offsets[0])
    row = np.repeat(np.arange(len(words)), words)
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.empty(0, np.int64)
    two = rolling.mixed(values[pair] * np.uint64(3) + rolling.mixed(values[pair + 1]))
    bucket = np.concatenate([values, two]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([row, row[pair]])


def model_counts(docs: DataFrame) -> DataFrame:
    """bucket, raw, target: n-grams of all documents and of those with ``good`` set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = byte_columns(batch.column(1))
            good = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(offsets, BATCH_BYTES):
                bucket, row = gram_buckets(data, offsets[a:b + 1])
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[a:b][row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])],
                                         names=["bucket", "raw", "target"])

    return (docs.select("good", "text").mapInArrow(run, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, smoothed; at most BUCKETS rows are read."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            data, offsets = byte_columns(batch.column(1))
            for a, b in slices(offsets, BATCH_BYTES):
                bucket, row = gram_buckets(data, offsets[a:b + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.bincount(row, minlength=b - a)),
                     pa.array(np.bincount(row, weights=ratio[bucket], minlength=b - a).astype(float).round(6))],
                    names=["doc_id", "n_grams", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and kept of every row of ``docs``."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good")))
    if share is None:
        share = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
        share = 1.0 if share is None else share
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the number of good documents grows with the corpus: no broadcast, at any size
    good = texts.join(known.where("good").hint("merge"), "doc_id", "left")
    ratios = log_ratios(model_counts(good))
    # a uniform in (0, 1) by the id's hash: the same draw whenever and wherever a task runs
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = cut_lineage(weighed(texts, ratios).withColumn(
        "gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), name="op5-scored")
    ids = scored.where("doc_id IS NOT NULL")
    k = int(np.ceil(share * ids.count()))
    # the k-th largest key, without sorting all rows in one task: a histogram narrows it down to its bucket
    bound = kth_largest(ids.select("gumbel_key", "doc_id"), k)
    kept = F.lit(False) if bound is None else (
        (F.col("gumbel_key") > bound[0]) | ((F.col("gumbel_key") == bound[0]) & (F.col("doc_id") <= bound[1])))
    return scored.withColumn("kept", F.coalesce(F.col("doc_id").isNotNull() & kept, F.lit(False)))


def kth_largest(rows: DataFrame, k: int, bins: int = 4096) -> tuple[float, int] | None:
    """(key, doc_id) of the k-th row by falling key, then rising id: the range of keys is cut into bins, and the bin
    that holds it again, until few rows are left."""
    if k <= 0:
        return None
    lo, hi, n = rows.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("*")).first()
    if not n:
        return None
    if k >= n:
        return lo, (1 << 63) - 1
    while n > 10_000 and hi > lo:
        width = (hi - lo) / bins
        if lo + width == lo:
            break
        counts = (rows.where(F.col("gumbel_key").between(lo, hi))
                  .groupBy(F.least(F.floor((F.col("gumbel_key") - lo) / width), F.lit(bins - 1)).alias("bin"))
                  .agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).collect())
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi, n = r["lo"], r["hi"], r["n"]
    row = (rows.where(F.col("gumbel_key").between(lo, hi)).orderBy(F.desc("gumbel_key"), "doc_id")
           .offset(k - 1).limit(1).first())
    return row["gumbel_key"], row["doc_id"]
