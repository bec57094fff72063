"""The corpus pipeline against its stages by brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from sitelore.llm import queries

from .test_operators import brute_components, brute_leaks, brute_quality, check_packing, frame, plain_words
from .test_repeats import brute, cut

SF = "/root/testdata/sf0.001"


def brute_kept(t):
    n_words, word_chars, n_symbols, n_dup_lines, _, failed = brute_quality(t)
    n_lines = sum(bool(plain_words(x)) for x in (t or "").split("\n"))
    return not (failed or 100 * n_symbols > 10 * word_chars or (n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines)
                or word_chars < 2 * n_words or word_chars > 20 * n_words)


def brute_texts(rows, items):
    """{doc_id: text} that reach the last stage."""
    rows = [(i, t) for i, t in rows if brute_kept(t)]
    components = brute_components(rows)
    texts = {i: t.encode() for i, t in rows if components[i][1] == i}
    spans = brute(texts, 100, True)
    texts = {i: b"".join(cut(t, spans[i])).decode("utf-8", "ignore") for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if t}
    leaks = {x[0] for x in brute_leaks(texts.items(), items)}
    return {i: t for i, t in texts.items() if i not in leaks}


def test_run_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    texts = brute_texts(rows, items)
    assert 0 < len(texts) < len(rows)
    check_packing(corpus_pipeline.run(spark, SF).collect(), texts)


def test_stages_keep_columns_and_clean_rows(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    shared = " ".join(f"shared{i}" for i in range(60))
    rows = [(1, clean + " é"), (2, clean + " é"), (3, shared + " " + " ".join(f"three{i}" for i in range(300))),
            (4, " ".join(f"four{i}" for i in range(300)) + " " + shared), (5, None), (6, "too short"), (None, clean + " none")]
    docs = frame(spark, rows)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {1, 3, 4, None} and left[1].text == clean + " é" and left[None].text == clean + " none"
    assert "shared30" in left[3].text and "shared30" not in left[4].text and left[4].n_chars == len(left[4].text)
    assert [r.words for r in left.values()] == ["x"] * 4


def test_empty_table(spark):
    docs = frame(spark, [(1, "x")]).where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]
