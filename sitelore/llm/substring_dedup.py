"""Substring dedup: remove words covered by a ``width``-word window that starts anywhere else too.

Every window has a Rabin-Karp hash, rolled over one polynomial prefix sum. Counting goes in two
steps, both over all documents: runs of windows with one anchor (``repeats``) are counted as one unit
by the hash of the whole run, and where an anchor has different runs, their windows are counted one by
one in Spark. Repeated windows merge into maximal removal intervals of each document.

Defined results: null text has no words; rows with a null doc_id take no part and stay whole; a repeated row (one
doc_id and text) repeats no window; different texts of one doc_id are different documents (``identities``); an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import rolling
from .identities import KEY, by_key, with_key
from .repeats import (BATCH_BYTES, OPEN, SPAN, array_slices, merged, positions_by_document, resolve, segment_rows,
                      unpacked)
from .texts import byte_columns, id_and_text, slices

WIDTH = 35
GRAM = 10


def word_pieces(data: np.ndarray, offsets: np.ndarray):
    """Words of the rows of a slice as (values, words in each row, byte start, byte end); a row of any length
    is read in parts that end at white space."""
    base, end = int(offsets[0]), int(offsets[-1])
    if len(offsets) > 2 or end - base <= 2 * BATCH_BYTES:
        return rolling.word_values(data, offsets)
    parts, a = [], base
    while a < end:
        b = min(end, a + BATCH_BYTES)
        while b < end and data[b] != 32 and not 9 <= data[b] <= 13:
            b += 1
        values, counts, lo, hi = rolling.word_values(data, np.array([a, b]))
        parts.append((values, counts, lo + a - base, hi + a - base))
        a = b
    values, counts, lo, hi = (np.concatenate(x) for x in zip(*parts))
    return values, counts.sum(keepdims=True), lo, hi


def word_tokens(width: int):
    def tokens(data: np.ndarray, offsets: np.ndarray):
        values, counts, _, _ = word_pieces(data, offsets)
        if len(counts) > 1 or len(values) <= 2 * BATCH_BYTES:
            yield values, np.cumsum(counts) - counts, counts, np.arange(len(counts)), np.zeros(len(counts), np.int64)
            return
        for a in range(0, len(values), BATCH_BYTES):
            part = values[a:a + BATCH_BYTES + width - 1]
            yield part, np.array([0]), np.array([len(part)]), np.array([0]), np.array([a])
    return tokens


def window_rows(opened: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(w, doc, pos): the hash of every window of the open segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_columns(batch.column(1))
            ids = batch.column(0).to_numpy()
            pos, at = array_slices(batch.column(2))
            for a, b in slices(offsets, BATCH_BYTES):
                values, counts, _, _ = word_pieces(data, offsets[a:b + 1])
                prefix = rolling.prefix_hash(values)
                start = np.cumsum(counts) - counts
                lo, n, _ = unpacked(pos[at[a]:at[b]])
                row = np.repeat(np.arange(b - a), np.diff(at[a:b + 1]))
                one = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                row = np.repeat(row, n)
                w = rolling.run_hash(prefix, start[row] + one, start[row] + one + width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.view(np.int64)), pa.array(ids[a:b][row]), pa.array(one << 20 | 1 << 10)],
                    names=["w", "doc", "pos"])

    texts = id_and_text(docs).join(positions_by_document(opened, "ps"), "doc_id").select("doc_id", "text", "ps")
    return texts.mapInArrow(run, "w long, doc long, pos long")


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, spans (removed [start, end) words) and kept (the other
    words joined by one space)."""
    rows, _ = with_key(id_and_text(docs))
    docs = by_key(rows)
    found = cut_lineage(resolve(segment_rows(docs, word_tokens(width), width, gram), keep_first=False),
                        name="op6-found")
    opened = found.where(F.col("kind") == OPEN).select("doc", "pos")
    windows = cut_lineage(window_rows(opened, docs, width), name="op6-windows")
    # a hot window is counted by partial sums; the join back splits its rows over tasks
    often = (windows.groupBy("w").agg(F.count("*").alias("n"), F.min("doc").alias("d0"), F.max("doc").alias("d1"),
                                      F.min("pos").alias("p0"), F.max("pos").alias("p1"))
             .where("d0 <> d1 OR p0 <> p1").select("w"))
    cuts = (found.where(F.col("kind") == SPAN).select("doc", "pos")
            .unionAll(windows.join(often, "w").select("doc", "pos")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = byte_columns(batch.column(1))
            pos, at = array_slices(batch.column(2))
            n_words, kept, spans = [], [], []
            for i in range(batch.num_rows):
                words = data[offsets[i]:offsets[i + 1]].tobytes().split()
                a, b = merged(pos[at[i]:at[i + 1]], width, len(words)) if at[i + 1] > at[i] else ((), ())
                n_words.append(len(words))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
                edges = [0, *(int(v) for xy in zip(a, b) for v in xy), len(words)]
                kept.append(b" ".join(w for x, y in zip(edges[::2], edges[1::2]) for w in words[x:y]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    cuts = positions_by_document(cuts, "cuts").withColumnRenamed("doc_id", KEY)
    return (rows.join(cuts, KEY, "left").select("doc_id", "text", "cuts")
            .mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"))


def digest(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
