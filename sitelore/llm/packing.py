"""Packing into sequences of at most ``capacity`` tokens as a cutting-stock problem solved by column generation.

1. Tasks tokenize whole texts; a document's full sequences are cut off first, so one shorter piece is left.
2. The left pieces are counted by length class (UNIT tokens wide): a histogram of at most capacity / UNIT rows, the
   only thing the driver reads. There a linear program over patterns (how many pieces of each class fill a
   sequence) is solved; its columns are priced by a dynamic program for the knapsack of the dual values.
3. The solution is rounded down and the few pieces left over are packed first-fit by falling length.
4. Pieces are ranked in their class (task-local ranks plus offsets of a small count table, no task sees a class
   whole), and a rank decides pattern, copy and so the sequence.

Defined results: a null or empty text is the end id alone; a null doc_id is packed like any other; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .texts import byte_columns, give_back, id_and_text
from .tokenizers import default_path, word_ids

CAPACITY = 4096
UNIT = 16
END_ID = 2
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, "
          "rank long, ids binary")


def pieces(docs: DataFrame, path: str, capacity: int, unit: int, with_ids: bool) -> DataFrame:
    """Pieces of all documents; class 0 fills a sequence, others have a rank inside (task, class)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        end = np.array([END_ID], "<u4").tobytes()
        task, ranks = TaskContext.get().partitionId(), np.zeros(capacity // unit + 2, np.int64)
        for batch in batches:
            data, offsets = byte_columns(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                got = encode(data[offsets[i]:offsets[i + 1]].tobytes()) + end
                n = len(got) // 4
                for a in range(0, n, capacity):
                    part = got[4 * a:4 * (a + capacity)]
                    m = len(part) // 4
                    c = 0 if m == capacity else -(-m // unit)
                    rows.append((ids[i], a, m, zlib.crc32(part), n, c, task, int(ranks[c]), part if with_ids else None))
                    ranks[c] += 1
                if len(rows) >= 5000 or i + 1 == batch.num_rows:
                    kinds = (pa.int64(),) * 5 + (pa.int32(), pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                                     names=[x.split()[0] for x in PIECES.split(", ")])
                    rows = []
            batch = data = offsets = None
            give_back()

    return id_and_text(docs).mapInArrow(run, PIECES)


def price(sizes: np.ndarray, duals: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best pattern for the dual values: an unbounded knapsack by dynamic programming over the room."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for cap in range(1, room + 1):
        fit = np.flatnonzero(sizes <= cap)
        best[cap] = best[cap - 1]
        if len(fit):
            value = best[cap - sizes[fit]] + duals[fit]
            k = int(np.argmax(value))
            if value[k] > best[cap] + 1e-12:
                best[cap], choice[cap] = value[k], fit[k]
    pattern, cap = np.zeros(len(sizes), np.int64), room
    while cap > 0:
        if choice[cap] < 0:
            cap -= 1
        else:
            pattern[choice[cap]] += 1
            cap -= sizes[choice[cap]]
    return float(best[room]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses): a basic optimal solution of the linear program min sum(uses), patterns @ uses = demand."""
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    uses = inverse @ demand
    for _ in range(40 * m + 100):
        duals = inverse.sum(axis=0)
        value, column = price(sizes, duals, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            break
        out = rows[int(np.argmin(uses[rows] / step[rows]))]
        ratio = uses[out] / step[out]
        uses = np.maximum(uses - ratio * step, 0)
        uses[out] = ratio
        patterns[:, out] = column
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    return patterns.round().astype(np.int64), uses


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, {class: pieces}) of every pattern; all pieces of the histogram are covered exactly."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    patterns, uses = column_generation(sizes, demand.astype(float), room)
    out, left = [], demand.copy()
    for k in np.argsort(-uses):
        used = patterns[:, k] > 0
        copies = int(min(np.floor(uses[k] + 1e-6), np.min(left[used] // patterns[used, k]))) if used.any() else 0
        if copies > 0:
            left -= copies * patterns[:, k]
            out.append((copies, {int(s): int(a) for s, a in zip(sizes[used], patterns[used, k])}))
    while left.any():  # the rounding's rest: one sequence after another, longest pieces first
        space, pattern = room, {}
        for i in range(len(sizes) - 1, -1, -1):
            k = int(min(left[i], space // sizes[i]))
            if k:
                pattern[int(sizes[i])] = k
                space -= k * int(sizes[i])
        copies = min(int(left[np.searchsorted(sizes, s)]) // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[np.searchsorted(sizes, s)] -= copies * k
        out.append((copies, pattern))
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, unit: int = UNIT,
         with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (and
    the ids as little-endian unsigned 32-bit, if asked for)."""
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, path or default_path(), capacity, unit, with_ids), name="op8-pieces")
    counts = cut_lineage(cut.groupBy("task", "class").agg(F.count("*").alias("n")), name="op8-counts")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    sequences = histogram.pop(0, 0)  # the full ones
    slots: list[tuple[int, int, int, int]] = []  # class, first rank, pieces in a copy, first sequence
    taken: dict[int, int] = {}
    for copies, pattern in plan(histogram, capacity // unit):
        for size, k in pattern.items():
            slots.append((size, taken.get(size, 0), k, sequences))
            taken[size] = taken.get(size, 0) + copies * k
        sequences += copies
    # at most one row for each class, with one entry for each pattern that uses it: bounded by (capacity / unit) ** 2
    starts = spark.createDataFrame([(0, 0, 1, 0), *slots], "class int, lo long, k long, first long")
    starts = starts.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("lo", "k", "first"))).alias("slots"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = (cut.join(offsets, ["task", "class"]).withColumn("at", F.col("rank") + F.col("ahead"))
              .join(F.broadcast(starts), "class")
              .withColumn("slot", F.element_at(F.filter("slots", lambda s: s["lo"] <= F.col("at")), -1))
              .withColumn("sequence_id", F.expr("slot.first + (at - slot.lo) div slot.k")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "at")
    out = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        (F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        F.sum("length").over(Window.partitionBy("sequence_id")).alias("sequence_tokens"),
        *(["ids"] if with_ids else []))
    return out
