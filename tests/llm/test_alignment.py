"""Cross-tokenizer alignment against both tokenizers on whole texts and all overlapping byte ranges."""

import collections
import hashlib

import pytest

from sitelore.llm import alignment, queries

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "   ", "a", "a ", " a", "a  b", "x\n y", "x\n\n  y", "tail   ", "don't  we'll", "<|endoftext|> <s>", "é中😀 ß",
         "▁", "a▁b", "\x00 \x1c", "12345 6.7", "a\tb\r\nc", "a\xa0 b　 c", "word " * 3000, "z" * 5000, "ab " * 10 + "\n" * 40,
         "end. No, yes; why?! é. 1, _."]
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    path_a, path_b = alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = alignment.byte_alphabet()
    docs, held = [], collections.Counter()
    for doc_id, text in rows:
        if not text:
            docs.append((doc_id, [], [], [], ""))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                   for i in ids_b]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            docs.append((doc_id, [], [], [], ""))
            continue
        spans_a, spans_b = spans(parts_a), spans(parts_b)
        links, first = [], 0
        for i, (lo, hi) in enumerate(spans_a):
            while spans_b[first][1] <= lo:
                first += 1
            for j in range(first, len(spans_b)):
                if spans_b[j][0] >= hi:
                    break
                links.append((ids_a[i], ids_b[j]))
        both = {hi for _, hi in spans_a} & {hi for _, hi in spans_b}
        groups, x, y = [], [], []
        i = j = 0
        for end in sorted(both):
            x, y = [], []
            while i < len(ids_a) and spans_a[i][1] <= end:
                x.append(ids_a[i])
                i += 1
            while j < len(ids_b) and spans_b[j][1] <= end:
                y.append(ids_b[j])
                j += 1
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        held.update(set(links))
        docs.append((doc_id, ids_a, ids_b, links, ";".join(groups)))
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return sorted(((i, len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(held[p] == top[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for i, x, y, links, g in docs), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a  b"), (3, "again"), (3, "a  b")]
    # clashing names of columns the operator makes itself
    return rows, spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, pair string, n int").repartition(3)


def test_op11_odd_texts(odd):
    rows, df = odd
    assert result(alignment.aligned(df)) == brute(rows)


def test_op11_join_instead_of_broadcast(odd):
    rows, df = odd
    assert result(alignment.aligned(df, most_pairs=0)) == brute(rows)


def test_op11_query_over_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    assert result(queries.op11_cross_tokenizer_alignment(spark, SF)) == brute(rows)


def test_op11_groups_and_empty_table(spark):
    df = spark.createDataFrame([(1, "lower lowest")], "doc_id long, text string")
    (row,) = alignment.aligned(df, with_groups=True).collect()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") + 1 == row.n_groups
    assert alignment.aligned(df.limit(0)).collect() == []


def test_op11_bounded_cache_and_partial_counts(odd, monkeypatch):
    rows, _ = odd
    align = alignment.Aligner(*alignment.default_paths())
    monkeypatch.setattr(alignment.Aligner, "LARGEST_CACHE", 3)
    texts = [t for _, t in rows if t]
    want = [e and [x[:5] for x in e] for e in align(texts)]
    for _ in range(2):
        assert [e and [x[:5] for x in e] for t in texts for e in align([t])] == want
    assert len(align.young) <= 3 + 2 * max(len(set(alignment.units_of(t))) for t in texts)


def test_op11_links_listed_more_than_255_times():
    align = alignment.Aligner(*alignment.default_paths())
    (entries,) = align(["word " * 3000 + "x, y! zz?"])
    import numpy as np
    import pyarrow as pa
    keys, times, n = alignment.unpacked(pa.array([b"", alignment.packed(entries)]))
    want = collections.Counter(np.frombuffer(b"".join(e[5] for e in entries), "<u4").tolist())
    got = collections.Counter()
    for k, t in zip(keys.tolist(), times.tolist()):
        got[k] += t
    assert got == want and n[0] == 0 and times.max() == 255
