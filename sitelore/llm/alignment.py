"""Cross-tokenizer alignment: where two tokenizers' tokens both end, a text is cut into groups; links join the tokens
of a group whose bytes overlap, and are counted over the corpus by document.

A group comes from the hash-set intersection of both lists of cumulative byte ends: dictionaries from end to index,
their common keys sorted, and the slices of both id lists between them; links are expanded slice by slice. A text is
first cut into *units*, before a space that follows no white space: neither vocabulary has a token across such a place
(checked when the files are read), so both tokenizers give a unit the ids it has in its text, and every unit ends a
group. Tasks keep the alignment of units in a bounded cache.

Texts are read once: every row's numbers, digest and distinct links (a blob of id pairs and how often each occurs) are
written, id pairs are counted by document from the blobs (summed in tasks before the shuffle), and a last pass over
the blobs reads the counts. They are broadcast after their number is read (at most ``most_pairs``); beyond that, links
are joined with the counts, pairs that many documents hold being spread by salt.

Defined results: null and empty texts, and those whose joined token bytes differ from space + text, have no tokens
(zeros, empty digest); a null doc_id and repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .texts import byte_columns, id_and_text, slices

#: characters of Unicode's White_Space property, as the byte-level pre-tokenizer knows them
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
SLICE_BYTES = 4 << 20
MOST_PAIRS = 4_000_000  # 17 bytes each when broadcast
HELD_PAIRS = 1_000_000  # in a task's partial counts
SALTS = 16
_white_then_space = re.compile(f"^ | $|[{WHITE}] ")
# fixed value: how a byte-level vocabulary cuts a text before it merges bytes
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_UNITS = 20_000
_marks_behind_letters = re.compile(r"( [^\W\d_]+)([.,;:!?]+)", re.ASCII)


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary and their bytes: printable Latin-1 stands for itself, the other bytes, in
    order, are the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


def units_of(text: str) -> list[str]:
    """Space + text, cut before every space that follows no white space."""
    pieces = text.split(" ")
    if not _white_then_space.search(text):
        return [" " + p for p in pieces]
    units, unit = [], " " + pieces[0]
    for p in pieces[1:]:
        if unit[-1] in WHITE:
            unit += " " + p
        else:
            units.append(unit)
            unit = " " + p
    if units and not unit.strip(" "):  # alone the last spaces would be an empty text to the model that adds one
        unit = units.pop() + unit
    units.append(unit)
    return units


def overlaps(ends_a: list[int], ends_b: list[int], part: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Index pairs of a slice's tokens whose byte ranges overlap (inside a slice no two ends are equal)."""
    i, to_i, j, to_j = part
    out = [(i, j)]
    while i + 1 < to_i or j + 1 < to_j:
        if ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1
        out.append((i, j))
    return out


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and ids of a byte-level file whose merges make the ids in order, without other steps; else None. Such
    a vocabulary has the same ids when merged by rank."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before, alphabet = file["model"], file["pre_tokenizer"] or {}, byte_alphabet()
    plain = (file["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
             and not model.get("ignore_merges") and before.get("type") == "ByteLevel"
             and not before.get("add_prefix_space") and before.get("use_regex", True))
    if not plain:
        return None
    added = {t["content"] for t in file.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    if any(c not in alphabet for t in vocab for c in t):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(x + y) != 256 + k for k, (x, y) in enumerate(pairs)):
        return None
    return {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}


Entry = tuple[int, int, int, int, str, bytes]


class Aligner:
    """Both tokenizers of a worker and its cache of aligned units: (A tokens, B tokens, groups, links, digest text, link
    keys), or None where a tokenizer's bytes are not the unit's. The cache has two generations: when the young one is
    full it becomes the old one, from which units still in use come back."""

    LARGEST_CACHE = 300_000  # units of a generation
    LONGEST_CACHED = 64

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in alphabet for c in token)
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:5], 16)]))
                continue
            if "▁" in piece.lstrip("▁") or _marks_behind_letters.search(" " + piece.lstrip("▁")):
                raise ValueError("a piece goes on behind the end of a word: units would not be exact")
            self.bytes_b.append(piece.replace("▁", " ").encode())
        self.width = len(self.bytes_b)
        if len(self.bytes_a) * self.width >= 1 << 32:
            raise ValueError("an id pair does not fit into 32 bits")
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # an id in the digest text, by what follows it: another id, the other tokenizer's ids, the next group
        self.texts_a, self.texts_b = ([np.array([f"{i}{mark}" for i in range(len(x))], object) for mark in marks]
                                      for x, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        ranks = merge_ranks(path_a)
        self.by_rank = None
        if ranks:
            import tiktoken
            self.by_rank = tiktoken.Encoding("by_rank", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.young: dict[str, Entry | None] = {}
        self.old: dict[str, Entry | None] = {}
        self.tails: dict[str, Entry | None] = {}

    def ids_of(self, text: str) -> tuple[list[int], list[int]]:
        """A and B ids of a text that begins with a space."""
        if self.by_rank and len(text) - max(text.rfind(" "), 0) <= self.LONGEST_CACHED:
            a = self.by_rank.encode_ordinary(text)
        else:
            a = self.a.encode(text, add_special_tokens=False).ids
        return a, self.b.encode(text[1:])  # the model adds the space

    def align(self, units: list[str]) -> list[Entry | None]:
        """Entries of units that begin with a space. Where the next one follows a space after no white space, the ids of
        the joined units are theirs one after another."""
        if not units:
            return []
        if len(units) > 1 and any(len(u) > self.LONGEST_CACHED or u[-1] in WHITE for u in units):
            alone = {u: self.align([u])[0] for u in units if len(u) > self.LONGEST_CACHED or u[-1] in WHITE}
            rest = [u for u in units if u not in alone]
            found = dict(zip(rest, self.align(rest))) | alone
            return [found[u] for u in units]
        out = self.entries(units, *self.ids_of("".join(units)))
        if out is None:  # some unit's bytes are lost: halves find it
            half = len(units) // 2
            return self.align(units[:half]) + self.align(units[half:]) if half else [None]
        return out

    def tail(self, marks: str) -> Entry | None:
        """The entry of marks behind a letter: the model's own space and a letter are taken off."""
        if marks not in self.tails:
            ids_a, ids_b = self.a.encode(marks, add_special_tokens=False).ids, self.b.encode("a" + marks)
            found = self.entries([marks], ids_a, ids_b[len(self.b.encode("a")):])
            self.tails[marks] = found[0] if found else None
        return self.tails[marks]

    def entries(self, units: list[str], ids_a: list[int], ids_b: list[int]) -> list[Entry] | None:
        """Entries of units by the ids of all of them, one after another; None if the bytes differ."""
        raw = [u.encode() for u in units]
        whole = b"".join(raw)
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b)) != whole:
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = self.length_a[a].cumsum().tolist(), self.length_b[b].cumsum().tolist()
        at_a, at_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
        ends = sorted(at_a.keys() & at_b.keys())
        # group g has the A tokens from cut_a[g] to cut_a[g + 1] and the B tokens from cut_b[g] to cut_b[g + 1]
        cut_a, cut_b = (np.array([0, *map(at.__getitem__, ends)], np.int64) for at in (at_a, at_b))
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        # links, slice by slice: with one token on a side it meets all of the other's, else neighbours overlap
        links = n_a + n_b - 1
        cut_links = np.concatenate([[0], links.cumsum()])
        group = np.repeat(np.arange(len(links)), links)
        nth = np.arange(cut_links[-1]) - cut_links[group]
        of_a, of_b = cut_a[group] + nth * (n_b[group] == 1), cut_b[group] + nth * (n_a[group] == 1)
        for g in np.flatnonzero((n_a > 1) & (n_b > 1)).tolist():
            pairs = overlaps(ends_a, ends_b, (int(cut_a[g]), int(cut_a[g + 1]), int(cut_b[g]), int(cut_b[g + 1])))
            of_a[cut_links[g]:cut_links[g + 1]], of_b[cut_links[g]:cut_links[g + 1]] = zip(*pairs)
        keys = (a[of_a] * self.width + b[of_b]).astype("<u4").tobytes()
        # the digest text has a group's A ids before its B ids
        text = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cut_a[1:] - 1], last_b[cut_b[1:] - 1] = True, True
        text[np.arange(len(a)) + np.repeat(cut_b[:-1], n_a)] = np.where(last_a, self.texts_a[1][a], self.texts_a[0][a])
        text[np.arange(len(b)) + np.repeat(cut_a[1:], n_b)] = np.where(last_b, self.texts_b[1][b], self.texts_b[0][b])
        words = text.tolist()
        # every unit ends a group
        stop = np.searchsorted(ends, np.cumsum([len(r) for r in raw])) + 1
        cuts = [np.concatenate([[0], c[stop]]) for c in (cut_a, cut_b, np.arange(len(ends) + 1), cut_links)]
        counts = [np.diff(c).tolist() for c in cuts]
        words_at, keys_at = (cuts[0] + cuts[1]).tolist(), (4 * cuts[3]).tolist()
        texts = ["".join(words[x:y])[:-1] for x, y in zip(words_at, words_at[1:])]
        return list(zip(*counts, texts, [keys[x:y] for x, y in zip(keys_at, keys_at[1:])]))

    def learn(self, asked: set[str]) -> None:
        """Entries of all units of a slice are in ``young``, long ones too until the slice is done."""
        young, old = self.young, self.old
        new = asked - young.keys()
        if len(young) + len(new) > self.LARGEST_CACHE:
            self.old = old = young
            self.young = young = {u: old[u] for u in asked & old.keys()}
        else:
            again = new & old.keys()
            young.update((u, old[u]) for u in again)
            new -= again
        marked = {}
        for u in [u for u in new if u[-1] in ".,;:!?"]:
            m = _marks_behind_letters.fullmatch(u)
            if m:
                marked[u] = m.groups()
                new.discard(u)
        new.update(stem for stem, _ in marked.values() if stem not in young)
        new = list(new)
        for at in range(0, len(new), CHUNK_UNITS):
            part = new[at:at + CHUNK_UNITS]
            young.update(zip(part, self.align(part)))
        for u, (stem, marks) in marked.items():
            x, y = young[stem], self.tail(marks)
            young[u] = x and y and (x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3], x[4] + ";" + y[4], x[5] + y[5])

    def __call__(self, texts: list[str | None]) -> list[list[Entry] | None]:
        """For each text its units' entries, or None if it has no tokens."""
        split = [units_of(t) if t else [] for t in texts]
        asked = set(chain.from_iterable(split))
        self.learn(asked)
        get = self.young.__getitem__
        out: list[list[Entry] | None] = []
        for units in split:
            got = list(map(get, units))
            out.append(None if not got or None in got else got)
        for u in [u for u in asked if len(u) > self.LONGEST_CACHED]:
            del self.young[u]
        return out


_aligners: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's tokenizers and cache."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def packed(entries: list[Entry]) -> bytes:
    """A document's distinct links: their keys (4 bytes each), then how often each occurs (1 byte each; a link found more
    than 255 times is listed again)."""
    keys, times = np.unique(np.frombuffer(b"".join([e[5] for e in entries]), "<u4"), return_counts=True)
    if len(times) and times.max() > 255:
        lists = -(-times // 255)
        keys, rest = np.repeat(keys, lists), np.repeat(times, lists)
        nth = np.arange(len(keys)) - np.repeat(np.cumsum(lists) - lists, lists)
        times = np.minimum(rest - 255 * nth, 255)
    return keys.astype("<u4").tobytes() + times.astype(np.uint8).tobytes()


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, times, number of links of each row) of blobs."""
    data, offsets = byte_columns(column)
    n = np.diff(offsets) // 5
    row_start = np.repeat(offsets[:-1] - offsets[0], n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    data = data[offsets[0]:offsets[-1]]
    at = row_start + 4 * nth
    keys = np.zeros(len(at), np.int64)
    for k in range(4):
        keys |= data[at + k].astype(np.int64) << (8 * k)
    return keys, data[row_start + 4 * np.repeat(n, n) + nth].astype(np.int64), n


WRITTEN = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary"


def with_links(docs: DataFrame, paths: tuple[str, str], with_groups: bool) -> DataFrame:
    """Every row's numbers, digest, groups (if asked for) and links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*paths)
        for batch in batches:
            _, offsets = byte_columns(batch.column(1))
            for at, to in slices(offsets, SLICE_BYTES):
                rows: list[tuple] = []
                for entries in align(batch.column(1).slice(at, to - at).to_pylist()):
                    if entries is None:
                        rows.append((0, 0, 0, 0, "", "" if with_groups else None, b""))
                        continue
                    a, b, groups, links, texts, _ = zip(*entries)
                    text = ";".join(texts)
                    rows.append((sum(a), sum(b), sum(groups), sum(links), hashlib.sha256(text.encode()).hexdigest(),
                                 text if with_groups else None, packed(entries)))
                kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]],
                    names=[c.split()[0] for c in WRITTEN.split(", ")])

    return docs.mapInArrow(run, WRITTEN)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair (A id * width + B id), n (documents that hold it linked) and best (n is the A id's highest)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            _, offsets = byte_columns(batch.column(0))
            for at, to in slices(offsets, SLICE_BYTES):
                keys, _, n = unpacked(batch.column(0).slice(at, to - at))
                first = np.ones(len(keys), bool)  # a link listed again counts once in its document
                first[1:] = keys[1:] != keys[:-1]
                first[(np.cumsum(n) - n)[n > 0]] = True
                found, times = np.unique(keys[first], return_counts=True)
                merged, place = np.unique(np.concatenate([held, found]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, times]), minlength=len(merged)).astype(np.int64)
                held = merged
            if len(held) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])
                held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])

    pairs = (rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
             .withColumn("a", F.expr(f"pair div {int(width)}")))
    return pairs.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best"))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most_pairs: int = MOST_PAIRS,
            with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row, and with ``with_groups`` the
    groups themselves as text (``a1,a2|b1;a3|b2,b3``)."""
    own_a, own_b = default_paths()
    paths = path_a or own_a, path_b or own_b
    rows = cut_lineage(with_links(id_and_text(docs), paths, with_groups), name="op11-links")
    counts = cut_lineage(pair_counts(rows, aligner(*paths).width), name="op11-pairs")
    out = by_broadcast(rows, counts) if counts.count() <= most_pairs else by_join(rows, counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                      *(["groups"] if with_groups else []))


def by_broadcast(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with n_best and count_sum."""
    table = counts.orderBy("pair").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(
        c.to_numpy(zero_copy_only=False) for c in (table["pair"], table["n"], table["best"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            for at, to in slices(byte_columns(batch.column(7))[1], SLICE_BYTES):
                part = batch.slice(at, to - at)
                keys, times, links = unpacked(part.column(7))
                place, row = np.searchsorted(pair, keys), np.repeat(np.arange(part.num_rows), links)
                sums = [np.bincount(row, weights=w, minlength=part.num_rows).astype(np.int64)
                        for w in (times * best[place], times * n[place])]
                yield pa.RecordBatch.from_arrays([*part.columns[:7], *map(pa.array, sums)],
                                                 names=[*part.schema.names[:7], "n_best", "count_sum"])

    return rows.mapInArrow(run, WRITTEN.replace("links binary", "n_best long, count_sum long"))


def by_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same without a broadcast: links are joined with their counts, each count spread over SALTS salts."""
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), name="op11-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(byte_columns(batch.column(1))[1], SLICE_BYTES):
                keys, times, links = unpacked(batch.column(1).slice(at, to - at))
                row = np.repeat(batch.column(0).slice(at, to - at).to_numpy(), links)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(keys), pa.array(times)],
                                                 names=["row", "pair", "times"])

    each = rows.select("row", "links").mapInArrow(run, "row long, pair long, times long").withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    sums = (each.join(salted, ["pair", "salt"]).groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    return rows.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
