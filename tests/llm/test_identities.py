"""Different texts under one doc_id are different documents in every operator that joins back to the rows."""

import hashlib
import random

import corpus_pipeline
import pytest

from sitelore.llm import identities, jaccard_join, substring_dedup, suffix_dedup

from .test_operators import brute_components, frame
from .test_repeats import brute_bytes, brute_words


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def numbers_of(rows):
    """{(doc_id, text): number}, by doc_id and then by the text's hash."""
    order = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda x: (x[0], sha(x[1])))
    return {x: k for k, x in enumerate(order)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(23)
    vocabulary = ["word%d" % i for i in range(3000)]

    def text(n):
        return " ".join(rng.choices(vocabulary, k=n))
    shared, out = text(60), [(2, text(90)), (2, None), (2, ""), (None, text(40)), (-5, "a b")]
    for k in range(30):  # one id with many texts, some of them near copies of each other or of those of other ids
        body = text(120)
        out += [(7, body), (7, body), (rng.choice([1, 7, 9, 40 + k]), body + " more"), (7, text(30) + " " + shared)]
    rng.shuffle(out)
    return out


def test_cuts_are_of_one_text(spark):
    x, tail = "lorem ipsum dolor " * 3 + "".join(chr(97 + i * 7 % 26) for i in range(200)), " tail of the second"
    unique = " ".join(str(i * i) for i in range(120))
    rows = [(1, x), (2, x + tail), (2, unique)]
    out = {r.kept: r for r in suffix_dedup.deduplicate(frame(spark, rows)).collect()}
    assert bytearray(unique.encode()) in [bytearray(k) for k in out] and len(out) == 3
    assert sorted(r.doc_id for r in out.values()) == [1, 2, 2]


def test_dedup_of_shared_ids_matches_brute_force(spark, rows):
    numbers = numbers_of(rows)
    unique = [(k, t) for (_, t), k in numbers.items()]
    df = frame(spark, rows).repartition(5)
    for result, brute in ((suffix_dedup.digest(suffix_dedup.deduplicate(df)), brute_bytes(unique)),
                          (substring_dedup.digest(substring_dedup.deduplicate(df)), brute_words(unique))):
        want = sorted((i, *brute[numbers[i, t or ""]]) for i, t in rows if i is not None)
        got = [tuple(r) for r in result.collect()]
        assert sorted(r for r in got if r[0] is not None) == want
        assert [r[2] for r in got if r[0] is None] == [0]


def test_components_of_shared_ids_match_brute_force(spark, rows):
    numbers = numbers_of(rows)
    ids = {k: i for (i, _), k in numbers.items()}
    brute = brute_components([(k, t) for (_, t), k in numbers.items()])
    df = frame(spark, rows).repartition(5)
    got = [tuple(r) for r in jaccard_join.near_duplicates(df).collect() if r.doc_id is not None]
    assert sorted(got) == sorted((ids[k], n, ids[c]) for k, (n, c) in brute.items())
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns
    want = sorted((i, t or "") for i, t in rows if i is not None and brute[numbers[i, t or ""]][1] == numbers[i, t or ""])
    assert sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None) == want


def test_numbers_only_where_ids_are_shared(spark, rows):
    assert identities.numbered(frame(spark, [(1, "x"), (1, "x"), (2, None), (2, ""), (None, "y"), (None, "z")])) is None
    got = {(r.own_id, r.version): r.number for r in identities.numbered(frame(spark, rows)).collect()}
    assert got == {(i, sha(t)): k for (i, t), k in numbers_of(rows).items()}


def test_pipeline_stages_leave_the_other_text_alone(spark):
    def text(tag, n=120):
        return " ".join(f"{tag}{i}" for i in range(n))
    clean, copied = text("clean"), text("copied")
    docs = frame(spark, [(1, copied), (3, copied + " x"), (3, clean)])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted([(1, copied), (3, clean)]), name
