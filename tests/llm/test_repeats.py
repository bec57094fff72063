"""Suffix-array and substring dedup against brute force, and their unusual inputs."""

import hashlib
import random
import re

import numpy as np
import pytest

from sitelore.llm import queries, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


def spans_of(starts, width):
    out = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + width)
        else:
            out.append([s, s + width])
    return out


def brute(sequences, width, keep_first):
    """{id: spans} where sequences is {id: bytes or list of words}."""
    seen, gone = {}, {i: set() for i in sequences}
    for i in sorted(sequences):
        s = sequences[i]
        for p in range(len(s) - width + 1):
            w = bytes(s[p:p + width]) if isinstance(s, bytes) else tuple(s[p:p + width])
            if w in seen:
                gone[i].add(p)
                if not keep_first:
                    gone[seen[w][0]].add(seen[w][1])
            else:
                seen[w] = (i, p)
    return {i: spans_of(g, width) for i, g in gone.items()}


def cut(s, spans):
    edges = [0, *(x for ab in spans for x in ab), len(s)]
    return [s[a:b] for a, b in zip(edges[::2], edges[1::2])]


def brute_bytes(rows, width=100):
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    spans = brute(texts, width, True)
    return {i: (len(t), sum(b - a for a, b in spans[i]), len(spans[i]),
                hashlib.sha256(b"".join(cut(t, spans[i]))).hexdigest()) for i, t in texts.items()}


def brute_words(rows, width=35):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows if i is not None}
    spans = brute(words, width, False)
    return {i: (len(w), sum(b - a for a, b in spans[i]),
                hashlib.sha256(" ".join(x for p in cut(w, spans[i]) for x in p).encode()).hexdigest())
            for i, w in words.items()}


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]


def test_op2_matches_brute_force(spark, documents):
    assert got(queries.op2_suffix_dedup(spark, SF)) == brute_bytes(documents)


def test_op6_matches_brute_force(spark, documents):
    assert got(queries.op6_substring_dedup(spark, SF)) == brute_words(documents)


def odd_rows():
    rng = random.Random(7)
    words = ["ab", "c", "déf", "ghij", "kl\x00m"]
    base = " ".join(rng.choice(words) for _ in range(300))
    rows = [(9, base), (1, base[40:900]), (2, "a" * 500), (3, "aaaa " * 90), (4, None), (5, ""), (6, " \t\n "),
            (7, base[:200] + "X" + base[200:]), (8, base), (10, "x" + base[100:320] + "y" + base[50:400])]
    for i in range(20, 45):  # one passage in ever other surroundings
        junk = lambda: " ".join(str(rng.random()) for _ in range(12))
        rows.append((i, f"{junk()} {base[300:300 + 120 + i]} {junk()} {base[60:60 + 8 * i]}"))
    return rows


@pytest.mark.parametrize("largest", [50_000, 3])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_odd_texts(spark, largest, adaptive):
    rows = odd_rows()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kept int, h string").repartition(5)
        assert got(suffix_dedup.digest(suffix_dedup.deduplicate(df, largest_bucket=largest))) == brute_bytes(rows)
        assert got(substring_dedup.digest(substring_dedup.deduplicate(df))) == brute_words(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_id_repeated_rows_and_empty_table(spark):
    text = "one two three four five six seven eight nine ten " * 5
    rows = [(None, text), (1, text), (1, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    two = suffix_dedup.digest(suffix_dedup.deduplicate(df)).collect()
    assert len(two) == 4 and all(r.n_removed == 0 for r in two if r.doc_id is None)
    assert {tuple(r[1:]) for r in two if r.doc_id == 1} == {brute_bytes([(1, text)])[1]}
    six = substring_dedup.digest(substring_dedup.deduplicate(df)).collect()
    assert len(six) == 4 and {tuple(r[1:]) for r in six if r.doc_id == 1} == {brute_words([(1, text)])[1]}
    none = df.limit(0)
    assert suffix_dedup.digest(suffix_dedup.deduplicate(none)).collect() == []
    assert substring_dedup.digest(substring_dedup.deduplicate(none)).collect() == []


def test_long_text_in_pieces(spark, monkeypatch):
    from sitelore.llm import repeats
    for m in (repeats, suffix_dedup, substring_dedup):
        monkeypatch.setattr(m, "BATCH_BYTES", 700)
    rng = random.Random(3)
    body = " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(1500))
    rows = [(1, body), (2, body[1000:3000] + " new " + body[2000:5000])]
    data = np.frombuffer(body.encode(), np.uint8)
    values, counts, _, _ = substring_dedup.word_pieces(data, np.array([0, len(data)]))
    assert counts.tolist() == [1500] and len(values) == 1500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(suffix_dedup.digest(suffix_dedup.deduplicate(df))) == brute_bytes(rows)
    assert got(substring_dedup.digest(substring_dedup.deduplicate(df))) == brute_words(rows)


def test_deep_shallow_sort_orders_like_python():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 3))) + b"z" * rng.choice([0, 40, 90])
               + bytes([rng.randint(0, 255)]) for _ in range(400)]
    bucket = np.sort(np.array([rng.randint(0, 5) for _ in strings]))
    rows = suffix_dedup.characters(strings, 100)
    order, lcp = suffix_dedup.deep_shallow_sort(rows, bucket)
    want = sorted(range(400), key=lambda i: (bucket[i], strings[i].ljust(104, b"\0")))
    pad = [s.ljust(104, b"\0") for s in strings]
    assert [(bucket[i], pad[i]) for i in order] == [(bucket[i], pad[i]) for i in want]
    for k in range(1, 400):
        a, b = pad[order[k - 1]], pad[order[k]]
        n = next((i for i in range(104) if a[i] != b[i]), 104)
        assert lcp[k] == (-1 if bucket[order[k]] != bucket[order[k - 1]] else n)


def equal_valued_words():
    """Two different words of 1,024 letters that any polynomial modulo 2 ** 64 takes for equal."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_with_equal_polynomials(spark):
    """op6 removes nothing and op10 links nothing where only such words differ."""
    from sitelore.llm import jaccard_join, substring_dedup
    one, two = equal_valued_words()
    head = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.digest(substring_dedup.deduplicate(docs)).collect()] == [0, 0]
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {1, 2}
