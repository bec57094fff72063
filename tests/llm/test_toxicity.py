"""Toxicity: the automaton against all edits, held-out accuracy, misspelled and quoted terms, unusual input."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from sitelore.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, held_out int, score string"
FILLER = ("river stone garden window letter morning bridge paper summer street table winter forest music kitchen "
          "yellow market doctor silver island").split()


def edits(word, letters="abcdé"):
    out = set()
    for i in range(len(word) + 1):
        for c in letters:
            out |= {word[:i] + c + word[i:], word[:i] + c + word[i + 1:]}
        out.add(word[:i] + word[i + 1:])
        if i < len(word) - 1:
            out.add(word[:i] + word[i + 1] + word[i] + word[i + 2:])
    return out - {word}


def test_op13_automaton_finds_all_edits():
    rng = random.Random(2)
    for _ in range(150):
        terms = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(4, 8))) for _ in range(rng.randint(1, 30))})
        trie = toxicity.Trie([(t, False, float(i + 1)) for i, t in enumerate(terms)])
        for _ in range(50):
            word = rng.choice(terms)
            for _ in range(rng.randint(0, 3)):
                word = rng.choice(sorted(edits(word)))
            near = [(terms.index(t) + 1.0, t) for t in terms if len(t) >= toxicity.FUZZY_FROM and word in edits(t)]
            want = ((word, 0, terms.index(word) + 1.0) if word in terms
                    else (max(near)[1], 1, max(near)[0]) if near else None)
            assert trie.find(word) == want


def corpus(n=400, seed=5):
    """Toxic documents hold one of two insults or a word of a family; clean ones none."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(FILLER) + rng.choice("abcdefgh") for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for at in rng.sample(range(60), 3):
                words[at] = rng.choice(["blockhead", "nitwit", "gruntl" + rng.choice(["ing", "er", "ed", "en"])])
        rows.append((i, " ".join(words), "en", 7, "x"))
        labels.append((i, int(toxic), 1))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


def judge(spark, model, texts, **options):
    docs = spark.createDataFrame([(i, t, "en", 7, "x") for i, t in enumerate(texts)], DOCS)
    return sorted(toxicity.scored(docs, model, **options).collect(), key=lambda r: r.doc_id)


def test_op13_lexicon_holds_terms_and_stems(model):
    assert {(t, stem) for t, stem, _ in model.terms} == {("blockhead", False), ("nitwit", False), ("gruntl", True)}


def test_op13_misspelled_and_quoted(spark, model):
    plain, wrong, innocent, quoted, family = judge(spark, model, [
        "you are a blockhead, river stone garden", "you are a blokchead, river stone garden", "river stone garden window letter",
        'he said the word "blockhead" was reported, river stone', "such gruntlish music in the street"], with_hits=True)
    assert plain.predicted and wrong.predicted and family.predicted and not innocent.predicted
    assert (wrong.n_misspelled, wrong.hits[0].term, wrong.hits[0].distance) == (1, "blockhead", 1)
    assert plain.n_quoted == 0 and quoted.n_quoted == 1 and quoted.score < plain.score
    assert innocent.score < min(plain.score, wrong.score, quoted.score)


def test_op13_unusual_input(spark, model):
    long = "river " * 200_000 + "nitwit nitwit nitwit"
    rows = [(1, None), (2, ""), (None, "nitwit"), (4, "nitwit"), (4, "nitwit"), (4, "river"), (5, long), (6, "\x00 ¡¿")]
    docs = spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], DOCS)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    low = min(r.score for r in got)
    assert all(r.score == low for r in got if r.doc_id in (1, 2, 6))
    assert [r.n_hits for r in got if r.doc_id == 5] == [3]
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.scored(docs.limit(0), model).collect() == []


def test_op13_sample_has_three_different_minima(spark):
    grams = spark.createDataFrame([([f"g{i}" for i in range(50)],), ([],), (None,)], "grams array<string>")
    got = grams.select(*[toxicity.least_hash(F.col("grams"), k).alias(f"m{k}") for k in range(3)]).collect()
    want = grams.limit(1).select(F.explode("grams").alias("g")).select(
        *[F.xxhash64("g", F.lit(k)).alias(f"m{k}") for k in range(3)]).collect()
    assert list(got[0]) == [min(r[k] for r in want) for k in range(3)] and len(set(got[0])) == 3
    assert not any(got[1]) and not any(got[2])


def test_op13_reads_no_held_out_label(spark):
    rows, labels = corpus(120)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    turned = [(i, 1 - t if i in held else t, q) for i, t, q in labels]
    docs = spark.createDataFrame(rows, DOCS)
    models = [toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int, quality int")) for x in (labels, turned)]
    assert held and models[0] == models[1]


def test_op13_without_usable_labels(spark):
    rows, labels = corpus(40)
    docs = spark.createDataFrame(rows, DOCS)
    schema = "doc_id long, toxic int, quality int"
    none = toxicity.judged(docs, spark.createDataFrame([], schema)).collect()
    assert len(none) == 40 and all(r.score < 0.01 for r in none)
    odd = [(None, 1, 1), (1, None, 1), (10_000, 1, 1), *[(i, 0, 1) for i in range(40)]]
    assert not any(r.predicted for r in toxicity.judged(docs, spark.createDataFrame(odd, schema)).collect())


def test_op13_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = queries.table(spark, sf, "labels")
    rows = queries.op13_toxicity(spark, sf).where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    right = sum(r.predicted and r.toxic for r in rows)
    precision, recall = right / sum(r.predicted for r in rows), right / sum(r.toxic for r in rows)
    assert precision > 0.95 and recall > 0.9
