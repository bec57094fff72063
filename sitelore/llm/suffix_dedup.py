"""Suffix-array dedup: remove bytes covered by a ``width``-byte string that also starts earlier.

The suffix array is sparse: one suffix for each segment anchor (``rolling``), plus the text before
the anchor read backwards, so every window is "d bytes of the second, width - d of the first".
Both are ordered by deep-shallow sorting: multikey quicksort (ternary partitions on eight-byte
characters) to a shallow depth, then a blind trie for each group that is still equal there.
Adjacent common prefixes cut the order into classes for every d, and of the windows of a class all
but the earliest go. Only segments whose anchor occurs with different surroundings are sorted;
equal ones are resolved by ``repeats``.

Defined results: null text is empty; rows with a null doc_id take no part and stay whole; a repeated row (one doc_id
and text) is no earlier copy; different texts of one doc_id are different documents, in the order of their SHA-256
(``identities``); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import rolling
from .identities import KEY, by_key, with_key
from .repeats import (BATCH_BYTES, OPEN, SPAN, array_slices, merged, packed, positions_by_document, resolve,
                      segment_rows, unpacked)
from .texts import byte_columns, id_and_text

WIDTH = 100
GRAM = 24
SHALLOW = 4  # eight-byte characters that multikey quicksort compares
#: An anchor with more different surroundings than this is compared by hashes of its windows in Spark instead.
LARGEST_BUCKET = 50_000


def byte_tokens(width: int):
    """Each row is one piece; a row over BATCH_BYTES is cut into pieces that share width - 1 bytes."""
    def tokens(data: np.ndarray, offsets: np.ndarray):
        size = int(offsets[-1] - offsets[0])
        if size <= 2 * BATCH_BYTES or len(offsets) > 2:
            starts = offsets[:-1] - offsets[0]
            yield (rolling.BYTE_VALUES[data[offsets[0]:offsets[-1]]], starts, np.diff(offsets),
                   np.arange(len(starts)), np.zeros(len(starts), np.int64))
            return
        for a in range(0, size, BATCH_BYTES):
            part = data[offsets[0] + a:offsets[0] + min(size, a + BATCH_BYTES + width - 1)]
            yield (rolling.BYTE_VALUES[part], np.array([0]), np.array([len(part)]), np.array([0]), np.array([a]))
    return tokens


def characters(strings: list[bytes], width: int) -> np.ndarray:
    """Strings padded to a multiple of eight bytes, as rows of big-endian 64-bit characters."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), ">u8").reshape(-1, width // 8)


def blind_order(keys: list[bytes]) -> list[int]:
    """Order of equally long strings by a blind trie: only branching bytes are looked at on the way down."""
    root: list = [-1, [0]]  # a leaf holds -1 and the strings equal to its first; a node its depth and children
    for i in range(1, len(keys)):
        s, node = keys[i], root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = keys[node[1][0]]
        if s == t:
            node[1].append(i)
            continue
        common = len(s) - ((int.from_bytes(s, "big") ^ int.from_bytes(t, "big")).bit_length() + 7) // 8
        above, node = None, root
        while 0 <= node[0] < common:
            above, node = node, node[1][s[node[0]]]
        if node[0] == common:
            node[1][s[common]] = [-1, [i]]
            continue
        split = [common, {s[common]: [-1, [i]], t[common]: node}]
        if above is None:
            root = split
        else:
            above[1][s[above[0]]] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_sort(rows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` inside each bucket (buckets are adjacent) and the common prefix, in bytes, of each
    row in that order with the one before it (-1 at a bucket's first)."""
    n, wide = rows.shape
    order = np.arange(n)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(start, n))
    depth = np.zeros(len(start), np.int64)
    deep: list[tuple[int, int]] = []
    while len(start):
        ready = depth >= min(SHALLOW, wide)
        deep += [(a, a + k) for a, k in zip(start[ready], size[ready]) if k > 1]
        go = ~ready & (size > 1)
        start, size, depth = start[go], size[go], depth[go]
        if not len(start):
            break
        group = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        character = rows[order[at], depth[group]]
        pivot = rows[order[start + size // 2], depth][group]
        side = group * 3 + (character > pivot) + (character >= pivot)
        moved = np.argsort(side, kind="stable")
        order[at] = order[at][moved]
        side = side[moved]
        new = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        size = np.diff(np.append(new, len(side)))
        start, depth = at[new], depth[group[new]] + (side[new] % 3 == 1)
    for a, b in deep:
        part = order[a:b]
        order[a:b] = part[blind_order([rows[i].tobytes() for i in part])]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        x = rows[order[1:]].astype(np.uint64) ^ rows[order[:-1]].astype(np.uint64)
        word = np.argmax(x != 0, axis=1)
        value = x[np.arange(n - 1), word]
        high = np.zeros(n - 1, np.int64)
        for shift in (32, 16, 8):  # leading zero bytes of the first character that differs
            zero = (value >> np.uint64(64 - shift)) == 0
            high += np.where(zero, shift // 8, 0)
            value = np.where(zero, value << np.uint64(shift), value)
        lcp[1:] = np.where(x.any(axis=1), word * 8 + high, wide * 8)
        lcp[1:][bucket[order[1:]] != bucket[order[:-1]]] = -1
    return order, lcp


def later_windows(bucket: np.ndarray, pos: np.ndarray, texts: list[bytes], width: int) -> list[tuple[int, int]]:
    """(row, window start) of every window that an earlier row of its bucket has too; rows stand in order of
    (bucket, document, position)."""
    lo, n, anchor = unpacked(pos)
    ahead = characters([t[a:a + width] for t, a in zip(texts, anchor)], width)
    behind = characters([t[:a][::-1] for t, a in zip(texts, anchor)], width)
    order_a, lcp_a = deep_shallow_sort(ahead, bucket)
    order_b, lcp_b = deep_shallow_sort(behind, bucket)
    out: list[tuple[int, int]] = []
    cls_a, cls_b = np.empty(len(pos), np.int64), np.empty(len(pos), np.int64)
    for d in range(int(anchor.max()) + 1):
        rows = np.flatnonzero((anchor >= d) & (anchor - n < d))
        if len(rows) < 2:
            continue
        cls_a[order_a] = np.cumsum(lcp_a < width - d)
        cls_b[order_b] = np.cumsum(lcp_b < d)
        pair = cls_a[rows] * (len(pos) + 1) + cls_b[rows]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        late = rows[order[1:][pair[1:] == pair[:-1]]]
        out += zip(late.tolist(), (lo[late] + anchor[late] - d).tolist())
    return out


def compared(rows: DataFrame, width: int) -> DataFrame:
    """Windows (doc, pos) that go, of open segments with their text, by the suffix order of each anchor's bucket."""
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        h, doc, pos = (table.column(i).to_numpy() for i in range(3))
        texts = table.column(3).to_pylist()
        late = later_windows(h, pos, texts, width)
        at = np.array([x[0] for x in late], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(packed(np.array([x[1] for x in late], np.int64), 1))], names=["doc", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole buckets, and the last one as far as it has come
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 20_000:
                continue
            h = batch.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # sorted: the last bucket starts here
            if cut:
                yield flush([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
            elif held[0].column(0)[0].as_py() != h[-1]:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.searchsorted(table.column(0).to_numpy(), h[-1]))
                yield flush(table.slice(0, cut).to_batches())
                held = table.slice(cut).to_batches()
        if held:
            yield flush(held)

    return rows.repartition("h").sortWithinPartitions("h", "doc", "pos").mapInArrow(run, "doc long, pos long")


def hashed(rows: DataFrame, width: int) -> DataFrame:
    """The same for buckets of any size: windows by 128-bit hash, the earliest by a partial minimum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, docs, starts = [], [], []
            for doc, pos, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                lo, n = pos >> 20, (pos >> 10) & 1023
                for i in range(n):
                    key.append(xxhash.xxh3_128_digest(text[i:i + width]))
                    docs.append(doc)
                    starts.append((lo + i) << 20 | 1 << 10)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(docs, pa.int64()),
                                              pa.array(starts, pa.int64())], names=["w", "doc", "pos"])

    windows = cut_lineage(rows.mapInArrow(run, "w binary, doc long, pos long"), name="op2-windows")
    first = windows.groupBy("w").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("c"))
    return (windows.join(first.where("c > 1"), "w")
            .where((F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos"))).select("doc", "pos"))


def with_text(open_rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(h, doc, pos, bytes) of open segments; each document's text is read once for all its segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_columns(batch.column(1))
            ids = batch.column(0).to_numpy()
            hs, at = array_slices(batch.column(2))
            ps, _ = array_slices(batch.column(3))
            for i in range(batch.num_rows):
                h, pos = hs[at[i]:at[i + 1]], ps[at[i]:at[i + 1]]
                lo, n, _ = unpacked(pos)
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                parts = [text[a:b] for a, b in zip(lo.tolist(), (lo + n - 1 + width).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(np.full(len(h), ids[i])), pa.array(pos), pa.array(parts, pa.binary())],
                    names=["h", "doc", "pos", "part"])

    need = (open_rows.groupBy("doc").agg(F.collect_list(F.struct("h", "pos")).alias("x"))
            .select(F.col("doc").alias("doc_id"), F.col("x.h").alias("hs"), F.col("x.pos").alias("ps")))
    texts = id_and_text(docs).join(need, "doc_id").select("doc_id", "text", "hs", "ps")
    return texts.mapInArrow(run, "h long, doc long, pos long, part binary").dropDuplicates(["h", "doc", "pos"])


def find_cuts(docs: DataFrame, width: int, gram: int, largest_bucket: int) -> DataFrame:
    """doc_id and the packed windows of it that go, in an array."""
    found = cut_lineage(resolve(segment_rows(docs, byte_tokens(width), width, gram), keep_first=True), name="op2-found")
    opened = found.where(F.col("kind") == OPEN).select("h", "doc", "pos")
    large = opened.groupBy("h").count().where(F.col("count") > largest_bucket).select("h")
    texts = cut_lineage(with_text(opened, docs, width), name="op2-open")
    cuts = (found.where(F.col("kind") == SPAN).select("doc", "pos")
            .unionAll(compared(texts.join(large, "h", "left_anti"), width))
            .unionAll(hashed(texts.join(large, "h", "left_semi"), width)))
    return positions_by_document(cuts, "cuts")


def removed(data: np.ndarray, offsets: np.ndarray, cuts: pa.Array, width: int):
    """(removed intervals, remaining bytes) of each row of a batch."""
    pos, at = array_slices(cuts)
    for i in range(len(offsets) - 1):
        text = data[offsets[i]:offsets[i + 1]]
        a, b = merged(pos[at[i]:at[i + 1]], width, len(text)) if at[i + 1] > at[i] else ((), ())
        edges = [0, *(int(v) for xy in zip(a, b) for v in xy), len(text)]
        yield ([{"start": int(x), "end": int(y)} for x, y in zip(a, b)],
               b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])))


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM,
                largest_bucket: int = LARGEST_BUCKET) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, spans (removed [start, end) bytes) and kept (binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = byte_columns(batch.column(1))
            spans, kept = zip(*removed(data, offsets, batch.column(2), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    rows, _ = with_key(id_and_text(docs))
    cuts = find_cuts(by_key(rows), width, gram, largest_bucket).withColumnRenamed("doc_id", KEY)
    return (rows.join(cuts, KEY, "left").select("doc_id", "text", "cuts")
            .mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"))


def rewritten(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, largest_bucket: int = LARGEST_BUCKET) -> DataFrame:
    """The rows of ``docs``, with all their columns, and in ``text`` what stays of it (a character that is cut into goes
    whole; ``n_chars``, if there, follows). A row of which nothing stays goes; one that had no text stays."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            old = batch.column(at)
            data, offsets = byte_columns(old)
            texts = [t.decode("utf-8", "ignore") for _, t in removed(data, offsets, batch.column(len(names)), width)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, old.type, mask=np.asarray(old.is_null()))
            if "n_chars" in names:
                k = names.index("n_chars")
                same = np.array([len(t.encode()) for t in texts]) == np.diff(offsets)
                n = [was if unchanged else len(t) for was, unchanged, t in zip(columns[k].to_pylist(), same, texts)]
                columns[k] = pa.array(n, columns[k].type)
            stays = np.array([bool(t) for t in texts]) | (np.diff(offsets) == 0)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    rows, _ = with_key(docs)
    cuts = find_cuts(by_key(rows), width, gram, largest_bucket).withColumnRenamed("doc_id", KEY)
    joined = rows.join(cuts, KEY, "left").select(*[rows[c] for c in names], cuts["cuts"])
    return joined.mapInArrow(run, docs.schema)


def digest(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                         F.sha2("kept", 256).alias("kept_sha256"))
