"""N-gram Jaccard join by T-occurrence search: documents whose sets of five-word shingles have a similarity of 0.75
or more are linked, exactly, and every document gets the smallest id reachable by links.

1. Each document's set is hashed; equal sets become one representative.
2. Candidate blocks. In any one order of all shingles, two linked sets share a shingle among their first
   ``n - ceil(3n/4) + 1``. The order here: shingles in the low QUANTILE of hashes that stand in one document only,
   then the others of that quantile, by rising number of documents, then the rest by hash. So only the low quantile is
   shuffled, shingles of one document end there, a document with enough of its own text has no candidates at all, and
   text that many documents share comes late, where it glues few of them together. Each inverted list links its
   members to its first (a star, not all pairs); the components of these stars are the blocks.
3. In a block, T-occurrence search: every document merges the short inverted lists of its shingles by a heap and
   binary-probes the long ones (DivideSkip), and keeps the documents that reach the required overlap. Documents
   already known to be in one component are not probed again. A block heavier than ``BLOCK_SHINGLES`` is cut into
   chunks and every two chunks meet in a task of their own, so no task holds more than two chunks.

Defined results: a null text or one without words has 0 shingles and no links; a null doc_id has no component and
no links; a repeated row (one doc_id and text) is one document with its first; different texts of one doc_id are
different documents, each with its own row (``identities``); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import rolling
from .components import connected_components
from .identities import KEY, by_key, own_ids, with_key
from .substring_dedup import word_pieces
from .texts import byte_columns, id_and_text, slices

BATCH_BYTES = 1 << 20  # of text at once in a task, which holds some sixty bytes for each
SHINGLE = 5
QUANTILE = 0.4
BLOCK_SHINGLES = 2_000_000
#: cost of a probe against that of merging an entry (DivideSkip's parameter for the number of long lists)
MU = 0.0085
TOKEN, DOCUMENT, NO_ID = 0, 1, 2
ROWS = "kind byte, token long, doc long, n long, prefix string"


def required(n: int, m: int) -> int:
    """Smallest intersection with 100 * i >= 75 * (n + m - i)."""
    return -(-3 * (n + m) // 7)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes (63 bits, ascending) of each row of a slice, and their number in each row."""
    text = data[offsets[0]:offsets[-1]]
    text = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
    values, words, _, _ = word_pieces(text, offsets - offsets[0])
    prefix = rolling.prefix_hash(values)
    start = np.cumsum(words) - words
    length = np.minimum(words, SHINGLE)
    count = np.where(words > 0, words - length + 1, 0)
    row = np.repeat(np.arange(len(words)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[row]
    h = (rolling.run_hash(prefix, at, at + length[row]) >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(words))


def shingle_rows(docs: DataFrame, quantile: float) -> DataFrame:
    """ROWS: low-quantile shingles (n: how many may be left out of the prefix) and one row for each document."""
    limit = int(quantile * (1 << 63))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.asarray(batch.column(0).is_null())
            every = batch.column(0).fill_null(0).to_numpy()
            data, offsets = byte_columns(batch.column(1))
            for a, b in slices(offsets, BATCH_BYTES):
                h, n = shingle_sets(data, offsets[a:b + 1])
                ids, lost = every[a:b], none[a:b]
                start = np.cumsum(n) - n
                some = np.flatnonzero(n > 0)
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(some):
                    u = h.view(np.uint64)
                    one[some] = np.add.reduceat(rolling.mixed(u), start[some])
                    two[some] = np.add.reduceat(rolling.mixed(u ^ np.uint64(0x5851F42D4C957F2D)), start[some])
                first: dict[tuple[int, int], int] = {}  # of equal sets the smallest id speaks
                for i in np.flatnonzero((n > 0) & ~lost):
                    k = (int(one[i]), int(two[i]))
                    if k not in first or ids[i] < ids[first[k]]:
                        first[k] = int(i)
                speaks = np.zeros(len(n), bool)
                speaks[list(first.values())] = True
                row = np.repeat(np.arange(len(n)), n)
                low = np.bincount(row[h < limit], minlength=len(n))
                prefix = n - (3 * n + 3) // 4 + 1
                sent = np.where(speaks, np.maximum(low, prefix), 0)
                out = (np.arange(len(h)) - start[row]) < sent[row]
                t, r = h[out], row[out]
                kind = np.concatenate([np.full(len(t), TOKEN, np.int8), np.where(lost, NO_ID, DOCUMENT).astype(np.int8)])
                names = [f"{x:016x}{y:016x}" for x, y in zip(one.tolist(), two.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(kind), pa.array(np.concatenate([t, one.view(np.int64)])),
                    pa.array(np.concatenate([ids[r], ids]), mask=np.concatenate([np.zeros(len(r), bool), lost])),
                    pa.array(np.concatenate([(sent - prefix)[r], n])),
                    pa.array([None] * len(t) + names, pa.string())], names=["kind", "token", "doc", "n", "prefix"])

    return id_and_text(docs).mapInArrow(run, ROWS)


def repeated_tokens(rows: DataFrame) -> DataFrame:
    """ROWS without the shingles that one document has; a partition is read once in order, with one row of state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, False  # the last shingle row, and whether the one before it had the same shingle
        for batch in batches:
            tokens = int(np.searchsorted(batch.column(0).to_numpy(), TOKEN, side="right"))
            if tokens < batch.num_rows:
                yield batch.slice(tokens)
            if not tokens:
                continue
            part = batch.slice(0, tokens)
            table = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks()
            t, d = table.column(1).to_numpy(), table.column(2).to_numpy()
            same = t[1:] == t[:-1]
            again = np.append(False, same & (d[1:] == d[:-1]))  # the same document read twice
            if again.any():
                table, t = table.filter(pa.array(~again)), t[~again]
                same = t[1:] == t[:-1]
            keep = np.append(known, same) | np.append(same, False)
            yield from table.slice(0, len(t) - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
            held, known = table.slice(len(t) - 1).combine_chunks().to_batches()[0], bool(keep[-1])
        if held is not None and known:
            yield held

    return (rows.repartition("token").sortWithinPartitions("kind", "token", "doc").mapInArrow(run, ROWS))


def linked(sets: list[np.ndarray]) -> list[int]:
    """For each set the position of one member of its component, the same for all members."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = [len(sets[i]) for i in order]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    owner = np.repeat(np.arange(len(order)), size)
    _, token, df = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    often = df[token] > 1
    owner, token = owner[often], token[often]
    by_token = np.argsort(token, kind="stable")
    lists = owner[by_token]  # inverted lists one after another, each by size of the documents
    place = np.empty(len(token), np.int64)
    place[by_token] = np.arange(len(token))
    begin = np.searchsorted(token[by_token], token)  # of its list, for each entry in document order
    at = np.searchsorted(owner, np.arange(len(order) + 1))
    plain = lists.tolist()
    for x in range(1, len(order)):
        b, e = begin[at[x]:at[x + 1]], place[at[x]:at[x + 1]]  # the lists up to x
        n, least = size[x], -(-3 * size[x] // 4)
        full = e > b
        if full.sum() < least:
            continue
        b, e = b[full], e[full]
        by_length = np.argsort(e - b, kind="stable")
        b, e = b[by_length], e[by_length]
        long_lists = min(least - 1, int(least / (MU * math.log2(max(2, int(e[-1] - b[-1]))) + 1)))
        short = len(b) - long_lists
        if int((e - b)[:short].sum()) <= 4096:
            counts = Counter(heapq.merge(*[plain[i:j] for i, j in zip(b[:short].tolist(), e[:short].tolist())]))
            found = sorted(counts.items(), key=lambda kv: -kv[1])
        else:  # the same merge by sorting, for many long runs
            ids, times = np.unique(np.concatenate([lists[i:j] for i, j in zip(b[:short], e[:short])]), return_counts=True)
            best = np.argsort(-times, kind="stable")
            found = list(zip(ids[best].tolist(), times[best].tolist()))
        probes = list(zip(b[short:].tolist(), e[short:].tolist()))
        for y, count in found:
            if count < least - long_lists:
                break
            if 4 * size[y] < 3 * n or find(y) == find(x):
                continue
            need, left = required(n, size[y]), len(probes)
            for i, j in probes:
                if count >= need or count + left < need:
                    break
                k = bisect_left(plain, y, i, j)
                count += k < j and plain[k] == y
                left -= 1
            if count >= need:
                root[find(x)] = find(y)
    out = [0] * len(sets)
    for x, i in enumerate(order):
        out[i] = order[find(x)]
    return out


def search(texts: DataFrame) -> DataFrame:
    """(doc, first): each document of a task with the smallest of its component there. ``texts``: block, i, j, doc,
    text; the rows with one (block, i, j) are searched together."""
    def solved(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        least: dict[int, int] = {}
        labels = linked(sets)
        for i, k in zip(ids, labels):
            least[k] = min(i, least.get(k, i))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([least[k] for k in labels], pa.int64())],
                                          names=["doc", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []
        for batch in batches:
            data, offsets = byte_columns(batch.column(4))
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            docs = batch.column(3).to_pylist()
            for a, b in slices(offsets, BATCH_BYTES):
                h, n = shingle_sets(data, offsets[a:b + 1])
                for i, part in zip(range(a, b), np.split(h, np.cumsum(n)[:-1])):
                    if keys[i] != key:
                        if len(ids) > 1:
                            yield solved(ids, sets)
                        key, ids, sets = keys[i], [], []
                    if len(part) and (not ids or docs[i] != ids[-1]):
                        ids.append(docs[i])
                        sets.append(part)
        if len(ids) > 1:
            yield solved(ids, sets)

    return (texts.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "doc")
            .mapInArrow(run, "doc long, first long"))


def near_duplicates(docs: DataFrame, quantile: float = QUANTILE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each document, and one for each row without an id."""
    rows, numbers = with_key(id_and_text(docs))
    return own_ids(components(by_key(rows), quantile, block_shingles), numbers, ["doc_id", "component_id"])


def representatives(docs: DataFrame, quantile: float = QUANTILE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the first document of each component (smallest doc_id, then
    SHA-256 of the text); rows without an id stay."""
    rows, _ = with_key(docs)
    gone = (components(by_key(rows), quantile, block_shingles).where("doc_id <> component_id")
            .select(F.col("doc_id").alias(KEY)))
    return rows.join(gone, KEY, "left_anti").select(*[rows[c] for c in docs.columns])


def components(docs: DataFrame, quantile: float, block_shingles: int) -> DataFrame:
    """The same as ``near_duplicates`` where every doc_id has one text."""
    rows = cut_lineage(repeated_tokens(shingle_rows(docs, quantile)), name="op10-shingles")
    sets = rows.where(F.col("kind") == DOCUMENT).groupBy("doc").agg(F.max("n").alias("n"), F.max("prefix").alias("set"))
    first = sets.where("n > 0").groupBy("set").agg(F.min("doc").alias("rep"), F.max("n").alias("n"))
    tokens = rows.where(F.col("kind") == TOKEN).select("token", "doc", F.col("n").alias("slack"))
    # the rarest of a document's repeated shingles: all but those that may be left out, which come last
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))  # a row each task and shingle, as rows lie by shingle
    late = Window.partitionBy("doc").orderBy(F.desc("often"), F.desc("token"))
    prefix = (tokens.join(often, "token").join(first.select(F.col("rep").alias("doc")), "doc", "left_semi")
              .withColumn("late", F.row_number().over(late)).where("late > slack").select("doc", "token"))
    prefix = cut_lineage(prefix, name="op10-prefix")
    hubs = prefix.groupBy("token").agg(F.min("doc").alias("hub"), F.count("*").alias("c")).where("c > 1")
    blocks = connected_components(prefix.join(hubs, "token").where("doc <> hub").select("doc", "hub"))

    sized = blocks.join(first.select(F.col("rep").alias("node"), "n"), "node")
    weights = sized.groupBy("component").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("chunks"))
    chunked = sized.join(weights, "component").select(
        F.col("node").alias("doc_id"), F.col("component").alias("block"), "chunks",
        F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("own"))
    chunked = cut_lineage(chunked, name="op10-blocks")
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("own")))
    tasks = chunked.select("doc_id", "block", "own", F.explode(other).alias("o")).select(
        "doc_id", "block", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    # the number of documents with candidates grows with the corpus: no broadcast, at any size
    texts = id_and_text(docs).join(tasks.hint("merge"), "doc_id").select("block", "i", "j", F.col("doc_id").alias("doc"), "text")
    found = cut_lineage(search(texts), name="op10-found")
    if chunked.where("chunks > 1").limit(1).count():  # a document was searched in several tasks
        found = connected_components(found).select(F.col("node").alias("doc"), F.col("component").alias("first"))

    component = (sets.join(first.select("set", "rep"), "set", "left")
                 .join(found.select(F.col("doc").alias("rep"), "first"), "rep", "left")
                 .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                         F.coalesce("first", "rep", "doc").alias("component_id")))
    lost = rows.where(F.col("kind") == NO_ID).select(
        F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return component.unionAll(lost)
