"""Toxicity: a lexicon of abusive terms in a trie, searched with Levenshtein automata, and context windows that tell
quotation from abuse.

1. *Sample.* At most ``most_labelled`` labelled documents (the ids of smallest hash; held-out ones never) are read;
   copies and near copies (an equal minimum of shingle hashes, three times) count once.
2. *Lexicon.* Words and word beginnings (stems) that the sample's toxic documents hold significantly more often are its
   terms, at most ``most_terms``, each weighed by the logarithm of its rates' ratio; nothing is taken from language,
   source or id.
3. *Search.* For every word the automaton of all strings within one edit (insertion, deletion, substitution, swap) of
   it runs over the trie; a branch ends when no state is alive. Stems match exactly, whole terms of FUZZY_FROM or
   more letters also misspelled. A near word that clean documents of the sample use is innocent.
4. *Context.* Quotation marks around a hit, words of reporting and of address within WINDOW words make a share of
   quotation; hits are summed as abusive, misspelled or quoted weight.
5. *Score.* Logistic regression on the logarithms of the three sums, of their share of the words and of the number of
   words, fitted to the sample around a prior that holds where the sample says nothing (say, no misspelled term in it).

Defined results: null and empty texts have no hits and the lowest score; a null doc_id is scored and not held out;
repeated rows are scored each; labels that contradict each other for one id count as toxic; without labelled rows of
both kinds every score is the share of toxic ones (0 without any); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import let
from ..session import cut_lineage
from .texts import byte_columns, grams_of, id_and_text, slices
from .texts import words_of as plain_words

MOST_LABELLED = 20_000
MOST_CANDIDATES = 200_000
MOST_TERMS = 20_000
LEAST_DOCS = 3
STEMS = range(3, 9)  # letters of a stem
MOST_REPEATS = 8  # that a document counts of a term
FUZZY_FROM = 5
WINDOW = 5
THRESHOLD = 0.3
SLICE_BYTES = 4 << 20
WORD = re.compile(r"[^\W_]+(?:[*@$!'’-][^\W_]+)*")

# fixed values: words of reporting and of address in the four languages of the corpus
REPORTING = {"said", "says", "called", "calls", "word", "words", "term", "quote", "quoted", "wrote", "reported", "according",
             "dijo", "dice", "palabra", "llamó", "escribió", "sagte", "sagt", "wort", "nannte", "schrieb", "dit", "mot",
             "appelé", "écrit"}
ADDRESS = {"you", "your", "you're", "youre", "u", "ur", "tu", "toi", "vous", "t'es", "du", "dich", "dein", "ihr", "tú", "eres",
           "usted", "vos"}
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "‹": "›"}


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never read: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Trie:
    """Lexicon terms; a node is (children, whole term's weight or None, stem's weight or None, the term)."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.root: list = [{}, None, None, ""]
        #: the first and last two letters of terms: one edit cannot touch both of a term of FUZZY_FROM letters
        self.heads, self.tails = set(), set()
        for term, stem, weight in terms:
            node = self.root
            for c in term:
                node = node[0].setdefault(c, [{}, None, None, ""])
            node[2 if stem else 1], node[3] = weight, term
            self.heads.add(term[:2])
            if not stem and len(term) >= FUZZY_FROM:
                self.tails.add(term[-2:])

    def exact(self, word: str) -> tuple[str, int, float] | None:
        """(term, 0, weight) of the word itself, else of its longest stem."""
        node, found = self.root, None
        for c in word:
            node = node[0].get(c)
            if node is None:
                return found
            if node[2] is not None:
                found = node[3], 0, node[2]
        return (node[3], 0, node[1]) if node[1] is not None else found

    def misspelled(self, word: str) -> tuple[str, int, float] | None:
        """(term, 1, weight) of the heaviest whole term one edit away: the word's automaton runs over the trie. Its states
        are bit sets over the word's places: without an edit, with one, and between the letters of a swap."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end, best = 1 << len(word), None
        todo = [(self.root, 1, 2, 0)]
        while todo:
            node, none, one, swap = todo.pop()
            weight = node[1]
            if weight is not None and one & end and not none & end and len(node[3]) >= FUZZY_FROM:
                if best is None or (weight, node[3]) > (best[2], best[0]):
                    best = node[3], 1, weight
            children = node[0]
            if none:
                nexts = children.items()
            else:  # only letters of places still alive lead on
                live, nexts = one | swap, []
                for c in {word[i] for i in range(len(word)) if live >> i & 1}:
                    if c in children:
                        nexts.append((c, children[c]))
            for c, child in nexts:
                m = masks.get(c, 0)
                still = (none & m) << 1
                edited = ((one & m) << 1) | none | (none << 1) | (still << 1) | ((swap & m) << 2)
                edited &= (end << 1) - 1
                swapped = none & (m >> 1)
                if still or edited or swapped:
                    todo.append((child, still, edited, swapped))
        return best

    def find(self, word: str) -> tuple[str, int, float] | None:
        near = word[-2:] in self.tails
        if word[:2] in self.heads:
            found = self.exact(word)
            if found:
                return found
            near = True
        return self.misspelled(word) if near and len(word) >= FUZZY_FROM - 1 else None


def quotation(text: str, start: int, end: int, before: list[str], after: list[str]) -> float:
    """Share of quotation of the hit text[start:end], by marks around it and the words of its window."""
    left, right = text[max(0, start - 80):start], text[end:end + 80]
    marked = 0
    for opening, closing in QUOTES.items():
        if opening == closing:
            line = text[text.rfind("\n", 0, start) + 1:start]
            marked |= line.count(opening) % 2 == 1 and closing in right
        else:
            marked |= left.rfind(opening) > left.rfind(closing) and closing in right
    near = set(before) | set(after)
    evidence = 3 * marked + 1.5 * bool(near & REPORTING) - 1.5 * bool(near & ADDRESS) - 1.5
    return 1 / (1 + math.exp(-evidence))


@dataclass
class Model:
    """Terms (term, is a stem, weight), weights of near words known from the sample, and the score's coefficients."""
    terms: list[tuple[str, bool, float]] = field(default_factory=list)
    variants: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    bias: float = -20.0


class Finder:
    """A model in a worker: finds hits, remembers words."""

    LARGEST_CACHE = 400_000

    def __init__(self, model: Model):
        self.model, self.trie = model, Trie(model.terms)
        self.known: set[str] = set()
        self.bad: dict[str, tuple[str, int, float]] = {}

    def learn(self, words: set[str]) -> None:
        new = words - self.known
        if len(self.known) + len(new) > self.LARGEST_CACHE:
            self.known, new = set(), words
        find, variants = self.trie.find, self.model.variants
        for word in new:
            found = find(word)
            if found and found[1]:
                weight = variants.get(word, found[2] / 2)
                found = (found[0], 1, weight) if weight > 0 else None
            if found:
                self.bad[word] = found
        self.known |= new

    def hits(self, text: str) -> list[tuple[int, int, str, str, int, float, float]]:
        """(start, end, word, term, distance, weight, share of quotation) of the hits of a lower-case text."""
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:b] for a, b in spans]
        out = []
        for i, word in enumerate(words):
            if word in self.bad:
                term, distance, weight = self.bad[word]
                share = quotation(text, *spans[i], words[max(0, i - WINDOW):i], words[i + 1:i + 1 + WINDOW])
                out.append((*spans[i], word, term, distance, weight, share))
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[list[tuple], int]]:
        """(hits, number of words) of every text."""
        split = [words_of(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return [(self.hits(t.lower()) if t and not self.bad.keys().isdisjoint(ws) else [], len(ws))
                for t, ws in zip(texts, split)]


def features(hits: list[tuple], n_words: int) -> tuple[float, ...]:
    """Logarithms of a document's abusive, misspelled and quoted weight, of all abuse in 100 words, and of its words."""
    abusive = sum(h[5] * (1 - h[6]) for h in hits if h[4] == 0)
    misspelled = sum(h[5] * (1 - h[6]) for h in hits if h[4])
    return (math.log1p(abusive), math.log1p(misspelled), math.log1p(sum(h[5] * h[6] for h in hits)),
            math.log1p(100 * (abusive + misspelled) / (n_words + 10)), math.log1p(n_words) if hits else 0.0)


def least_hash(grams: Column, seed: int) -> Column:
    """The smallest of the grams' hashes with a seed; null without grams."""
    return let(grams, lambda g: F.array_min(F.transform(g, lambda x: F.xxhash64(x, F.lit(seed)))))


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and toxic (boolean) of the labelled sample; at most ``most`` ids are broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = (known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = id_and_text(docs).where("text IS NOT NULL").join(F.broadcast(known), "doc_id")
    rows = rows.select("text", "toxic", F.xxhash64("text").alias("h"), grams_of(plain_words(F.col("text")), 5).alias("grams"))
    for seed in range(3):
        rows = rows.withColumn(f"m{seed}", F.coalesce(least_hash(F.col("grams"), seed), F.col("h")))
    rows = rows.drop("grams")
    for seed in range(3):
        rows = rows.groupBy(f"m{seed}", "toxic").agg(F.min_by(F.struct("text", "h", "m0", "m1", "m2"), "h").alias("r")).select(
            "toxic", "r.*")
    return cut_lineage(rows.select("text", "toxic"), name="op13-sample")


def term_counts(rows: DataFrame, only: set[str] | None = None) -> DataFrame:
    """term, docs and times: documents of ``rows`` (text) with a word (``word$``) or a stem of a word, and how often (at most
    MOST_REPEATS times each document); the empty term counts all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: Counter = Counter()
        times: Counter = Counter()

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array([docs[t] for t in times], pa.int64()),
                                               pa.array(list(times.values()), pa.int64())], names=["term", "docs", "times"])

        for batch in batches:
            for text in batch.column(0):
                words = Counter(words_of(text.as_py()))
                times[""] += words.total()
                found: Counter = Counter()
                for w, n in words.items():
                    for term in chain((w + "$",), (w[:k] for k in STEMS if len(w) > k)):
                        if only is None or term in only:
                            found[term] += n
                docs.update(found.keys())
                for term, n in found.items():
                    times[term] += min(n, MOST_REPEATS)
                if len(times) > 500_000:
                    yield emitted()
                    docs.clear(), times.clear()
        yield emitted()

    return (rows.select("text").mapInArrow(run, "term string, docs long, times long").groupBy("term")
            .agg(F.sum("docs").alias("docs"), F.sum("times").alias("times")))


Counts = dict[str, tuple[int, int]]  # term: documents, times


def surprise(a: float, b: float, share: float) -> float:
    """Twice the log likelihood ratio of a of a + b events where a share of all was expected."""
    n = a + b
    return 2 * ((a * math.log(a / (n * share)) if a else 0) + (b * math.log(b / (n * (1 - share))) if b else 0))


def chosen(toxic: Counts, clean: Counts, n_toxic: int, n_clean: int, most: int) -> list[tuple[str, bool, float]]:
    """The lexicon: terms that toxic documents hold significantly more often, the strongest first, none that begins
    another or begins with one."""
    words = max(toxic[""][1], 1), max(clean.get("", (0, 0))[1], 1)
    doc_share, word_share = n_toxic / (n_toxic + n_clean), words[0] / sum(words)
    bound, ranked = 2 * math.log(max(len(toxic), 2)) + 4, []
    for term, (docs, times) in toxic.items():
        other_docs, others = clean.get(term, (0, 0))
        weight = math.log((times + 0.5) / words[0]) - math.log((others + 0.5) / words[1])
        if term and docs >= LEAST_DOCS and weight > 1.5 and docs / (docs + other_docs) > doc_share:
            if surprise(docs, other_docs, doc_share) > bound:
                ranked.append((-surprise(times, others, word_share), -len(term), term, weight))
    taken: set[str] = set()
    heads: set[str] = set()  # all beginnings of taken terms
    out = []
    for _, _, term, weight in sorted(ranked):
        if term in heads or any(term[:k] in taken for k in range(1, len(term))):
            continue
        taken.add(term)
        heads.update(term[:k] for k in range(1, len(term) + 1))
        out.append((term.rstrip("$"), not term.endswith("$"), round(weight, 6)))
        if len(out) >= most:
            break
    return out


def near_words(sample: DataFrame, model: Model) -> dict[str, float]:
    """Weights of the misspelled terms in the sample: half the term's weight, less where clean documents use the word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, found = Trie(model.terms), Counter()
        seen: dict[str, float | None] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                for word in set(words_of(text.as_py())):
                    if word not in seen:
                        hit = trie.find(word)
                        seen[word] = hit[2] if hit and hit[1] else None
                    if seen[word] is not None:
                        found[word, seen[word], toxic.as_py()] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.float64()),
             pa.array([n if k[2] else 0 for k, n in found.items()], pa.int64()),
             pa.array([0 if k[2] else n for k, n in found.items()], pa.int64())], names=["word", "weight", "toxic", "clean"])

    rows = (sample.mapInArrow(run, "word string, weight double, toxic long, clean long").groupBy("word", "weight")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    out = {}
    for r in rows.collect():  # at most the near words of the sample
        # half a term's weight; where clean documents use the word, not above the word's own odds
        odds = (math.log((r["toxic"] + 0.5) / (totals.get(True, 0) + 1))
                - math.log((r["clean"] + 0.5) / (totals.get(False, 0) + 1)))
        out[r["word"]] = round(min(r["weight"] / 2, odds) if r["clean"] else r["weight"] / 2, 6)
    return out


def fitted(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = (1.0, 0.7, 0.0, 0.5, 0.0), strength: float = 1.0) -> np.ndarray:
    """Logistic regression (coefficients, bias) with a normal prior around ``prior``, by Newton steps."""
    design = np.hstack([x, np.ones((len(x), 1))])
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    middle = np.array([*prior, math.log(share / (1 - share)) - 2])
    precision = np.diag([*[strength] * x.shape[1], 0.1])
    w = middle.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + precision @ (w - middle)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + precision
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_terms: int = MOST_TERMS) -> Model:
    """The model of a labelled table (doc_id, toxic 0 or 1); held-out rows are not read."""
    sample = sampled(docs, labels, most_labelled)
    toxic, clean = sample.where("toxic"), sample.where("NOT toxic")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return Model(bias=20.0 if n_toxic else -20.0)
    wanted = term_counts(toxic).where((F.col("docs") >= LEAST_DOCS) | (F.col("term") == ""))
    held = {r["term"]: (r["docs"], r["times"])
            for r in wanted.orderBy(F.desc("docs"), "term").limit(MOST_CANDIDATES).unionAll(wanted.where("term = ''")).collect()}
    others = {r["term"]: (r["docs"], r["times"]) for r in term_counts(clean, set(held)).collect()}
    model = Model(chosen(held, others, n_toxic, n_clean, most_terms))
    model.variants = near_words(sample, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model)
        for batch in batches:
            found = [features(*h) for h in find(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = sample.mapInArrow(run, "x array<double>, toxic boolean").toArrow()
    x, y = np.array(rows["x"].to_pylist()), rows["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same sums whatever the rows' order
    w = fitted(x[order], y[order]).round(9).tolist()
    model.weights, model.bias = tuple(w[:-1]), w[-1]
    return model


HITS = "array<struct<start:int,end:int,word:string,term:string,distance:int,weight:double,quotation:double>>"


def scored(docs: DataFrame, model: Model, with_hits: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, n_misspelled, n_quoted of every row, and with ``with_hits`` the hits
    (places in the lower-case text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_TERMS terms and the sample's near words
    rows = id_and_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, find = shared.value, Finder(shared.value)
        for batch in batches:
            _, offsets = byte_columns(batch.column(2))
            for at, to in slices(offsets, SLICE_BYTES):
                found = find(batch.column(2).slice(at, to - at).to_pylist())
                values = [model.bias + sum(w * v for w, v in zip(model.weights, features(*f))) for f in found]
                found = [h for h, _ in found]
                score = [1 / (1 + math.exp(-min(max(v, -500), 500))) for v in values]
                out = [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(score, pa.float64()),
                       pa.array([int(s >= THRESHOLD) for s in score], pa.int32()),
                       pa.array([len(h) for h in found], pa.int64()),
                       pa.array([sum(x[4] > 0 for x in h) for h in found], pa.int64()),
                       pa.array([sum(x[6] >= 0.5 for x in h) for h in found], pa.int64())]
                names = ["doc_id", "held_out", "score", "predicted", "n_hits", "n_misspelled", "n_quoted"]
                if with_hits:
                    keys = ("start", "end", "word", "term", "distance", "weight", "quotation")
                    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64())
                    out.append(pa.array([[dict(zip(keys, x)) for x in h] for h in found], pa.list_(pa.struct(list(zip(keys, kinds))))))
                    names.append("hits")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long, n_misspelled long, "
                                "n_quoted long" + (f", hits {HITS}" if with_hits else ""))


def judged(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """Every row of ``docs`` scored by a model of ``labels``."""
    return scored(docs, train(docs, labels, **limits))
