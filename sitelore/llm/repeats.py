"""Finding repeated windows over all documents: the part that suffix_dedup and substring_dedup share.

Stage rows are segments (``rolling.segments``), packed into four longs: anchor hash, hash of the
whole segment, document, and position (``lo << 20 | windows << 10 | anchor offset``). Copies met in
one batch are combined before the shuffle, so a segment that stands in a third of all documents
costs one row a batch. Sorted by (anchor, segment, document, position), a partition is then read once
with constant state: equal segments are resolved whole, and only one representative of each of
several different segments with one anchor goes on to be compared window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .texts import byte_columns, id_and_text, slices

BATCH_BYTES = 2 << 20
SEGMENT_ROWS = "h long, g long, doc long, pos long, others binary"
FOUND_ROWS = "kind byte, h long, doc long, pos long"
SPAN, OPEN = 0, 1  # FOUND_ROWS.kind: windows to remove; a segment to compare window by window


def packed(lo: np.ndarray, n: np.ndarray | int, anchor: np.ndarray | int = 0) -> np.ndarray:
    return (lo.astype(np.int64) << 20) | (np.asarray(n, np.int64) << 10) | np.asarray(anchor, np.int64)


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 20, (pos >> 10) & 1023, pos & 1023


#: of one batch of rows: (tokens as 64-bit values, start and length of each piece, row and first token of each piece)
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def segment_batch(tokens: Tokens, ids: np.ndarray, width: int, gram: int) -> pa.RecordBatch:
    values, starts, lengths, rows, firsts = tokens
    found = rolling.segments(values, starts, lengths, width, gram)
    piece = np.searchsorted(starts, found.lo, side="right") - 1
    doc = ids[rows[piece]] if len(piece) else np.empty(0, np.int64)
    pos = packed(found.lo - starts[piece] + firsts[piece], found.n, found.anchor)
    h, g = found.key.view(np.int64), found.whole.view(np.int64)
    order = np.lexsort((pos, doc, g, h))
    h, g, doc, pos = h[order], g[order], doc[order], pos[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    first = np.flatnonzero(~same)
    others: list[bytes | None] = [None] * len(first)
    for k in np.flatnonzero(np.diff(np.append(first, len(h))) > 1):
        a, b = first[k], first[k + 1] if k + 1 < len(first) else len(h)
        more = np.unique(np.stack([doc[a:b], pos[a:b]], 1), axis=0)[1:]
        others[k] = more.tobytes() if len(more) else None
    return pa.RecordBatch.from_arrays(
        [pa.array(x[first]) for x in (h, g, doc, pos)] + [pa.array(others, pa.binary())],
        names=["h", "g", "doc", "pos", "others"])


def segment_rows(docs: DataFrame, tokenize: Callable[[np.ndarray, np.ndarray], Iterator[Tokens]],
                 width: int, gram: int) -> DataFrame:
    """Segments of all documents with an id; ``tokenize`` turns a slice of rows into token pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = byte_columns(batch.column(1))
            for a, b in slices(offsets, BATCH_BYTES):
                for tokens in tokenize(data, offsets[a:b + 1]):
                    yield segment_batch(tokens, ids[a:b], width, gram)

    return id_and_text(docs).where("doc_id IS NOT NULL").mapInArrow(run, SEGMENT_ROWS)


def resolve(rows: DataFrame, keep_first: bool) -> DataFrame:
    """FOUND_ROWS of segment rows. ``keep_first``: the earliest of equal segments stays."""
    def finish(kind: int, h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(h), kind, np.int8)), pa.array(h), pa.array(doc), pa.array(pos)],
            names=["kind", "h", "doc", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group's first row, its members so far, and whether its anchor came before
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            others, more = batch.column(4), np.ones(len(h), np.int64)
            full = np.flatnonzero(~np.asarray(others.is_null()))
            if len(full):
                lists = [np.frombuffer(others[int(k)].as_py(), np.int64).reshape(-1, 2) for k in full]
                counts = np.array([len(x) for x in lists])
                more[full] += counts
                pairs = np.concatenate(lists)
                yield finish(SPAN, np.repeat(h[full], counts), pairs[:, 0], pairs[:, 1])
            before = False
            if held is not None:
                h, g, doc, pos, more = (np.concatenate([[x], y]) for x, y in zip(held[:5], (h, g, doc, pos, more)))
                before = held[5]
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
            again = np.zeros(len(h), bool)  # the same document read twice
            again[1:] = same[1:] & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
            first = np.flatnonzero(~same)
            members = np.add.reduceat(np.where(again, more - 1, more), first)
            yield finish(SPAN, h[same & ~again], doc[same & ~again], pos[same & ~again])
            near = np.zeros(len(first) + 1, bool)  # near[k]: group k has the anchor of group k - 1
            near[0], near[1:-1] = before, h[first[1:]] == h[first[:-1]]
            done = first[:-1]
            mixed = near[:-2] | near[1:-1]
            yield finish(OPEN, h[done[mixed]], doc[done[mixed]], pos[done[mixed]])
            if not keep_first:
                gone = done[members[:-1] > 1]
                yield finish(SPAN, h[gone], doc[gone], pos[gone])
            k = first[-1]
            held = (h[k], g[k], doc[k], pos[k], members[-1], bool(near[len(first) - 1]))
        if held is not None:
            h, doc, pos = (np.array([held[i]]) for i in (0, 2, 3))
            if held[5]:
                yield finish(OPEN, h, doc, pos)
            if not keep_first and held[4] > 1:
                yield finish(SPAN, h, doc, pos)

    return (rows.repartition("h").sortWithinPartitions("h", "g", "doc", "pos")
            .mapInArrow(run, FOUND_ROWS))


def positions_by_document(rows: DataFrame, name: str) -> DataFrame:
    """``pos`` of each document as an array: no longer than the document has segments or windows."""
    return rows.groupBy("doc").agg(F.collect_list("pos").alias(name)).withColumnRenamed("doc", "doc_id")


def array_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An array<long> column as (all values, offsets); null rows are empty."""
    if column.null_count:
        column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int64()))
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def merged(pos: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by the windows, clipped to the document."""
    lo, n, _ = unpacked(np.sort(pos))
    hi = np.minimum(np.maximum.accumulate(lo + n - 1 + width), length)
    lo = np.minimum(lo, length)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    starts, ends = lo[first], hi[np.append(first[1:], len(lo)) - 1]
    some = ends > starts
    return starts[some], ends[some]
