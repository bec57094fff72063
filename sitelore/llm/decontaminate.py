"""Benchmark decontamination: short test items that stand inside long documents, by containment of five-word shingles.

Size-partitioned MinHash containment search: items are partitioned by the power of two of their shingle count, and
an item's sketch is its bottom-k of shingle hashes, k from its partition's upper bound u: u - ceil(0.75 u) + 1.
A document that contains 0.75 of an item's shingles holds at least one of any that many, so probing all shingles of
a document against the sketches finds every leak (no false negatives); candidates are then verified by exact
shingle containment. Only built-in expressions; documents are not shuffled for the search.

Words are runs of ASCII letters and digits and of all other characters than ASCII, A-Z lower-cased. Defined results:
an item of one to four words is one whole sequence, searched among the documents' runs of as many words; null texts
and those without words neither leak nor match; repeated items count once, different texts of one item_id are searched
each; a null doc_id or item_id is neither searched nor found; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import let
from ..session import cut_lineage
from .texts import NON_ALNUM, grams_of, id_and_text, lower_ascii, words_of

SHINGLE = 5
#: A sketch table of more rows than this is joined by a shuffle instead of a broadcast (16 bytes a row).
BROADCAST_ROWS = 1_000_000


def shingles(text: Column, k: int = SHINGLE) -> Column:
    return grams_of(words_of(lower_ascii(text), NON_ALNUM), k)


def runs(text: Column, lengths: list[int]) -> Column:
    """Shingles, and the runs of each of ``lengths`` words (those of shorter items)."""
    if not lengths:
        return shingles(text)
    return let(words_of(lower_ascii(text), NON_ALNUM), lambda w: F.concat(*[grams_of(w, k) for k in [SHINGLE, *lengths]]))


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, version (of its text), short (its words, if fewer than a shingle), grams (distinct), n, and k of the
    item's size partition."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    words = F.size("words")
    whole = [F.when(words == i, grams_of(F.col("words"), i)).otherwise(F.array().cast("array<bigint>"))
             for i in range(1, SHINGLE)]
    return (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .where("item_id IS NOT NULL").distinct()
            .select("item_id", F.xxhash64("text").alias("version"), words_of(lower_ascii(F.col("text")), NON_ALNUM).alias("words"))
            .select("item_id", "version", F.when(words < SHINGLE, words).alias("short"),
                    F.array_distinct(F.concat(grams_of(F.col("words"), SHINGLE), *whole)).alias("grams"))
            .withColumn("n", F.size("grams")).where("n > 0")
            .withColumn("k", (upper - F.ceil(upper * 3 / 4) + 1).cast("int")))


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_common, containment of every document and item it contains."""
    known = cut_lineage(item_shingles(items), name="op4-items")
    sketches = known.select(F.struct("item_id", "version").alias("item"),
                            F.explode(F.slice(F.sort_array("grams"), F.lit(1), F.col("k"))).alias("gram"))
    total, short = known.agg(F.sum("k"), F.collect_set("short")).first()
    if (total or 0) <= BROADCAST_ROWS:
        sketches = F.broadcast(sketches)
    texts = id_and_text(docs).where("doc_id IS NOT NULL")
    grams = runs(F.col("text"), sorted(short))
    probes = texts.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram"))
    pairs = probes.join(sketches, "gram").groupBy("doc_id").agg(F.collect_set("item").alias("items"))
    pairs = cut_lineage(pairs, name="op4-candidates")
    held = (texts.join(pairs, "doc_id").select("doc_id", "items", grams.alias("doc_grams"))
            .select("doc_id", F.explode("items").alias("item"), "doc_grams")
            .select("doc_id", "item.item_id", "item.version", "doc_grams")
            .join(known, ["item_id", "version"])
            .select("doc_id", "item_id", F.col("n").cast("long").alias("n_item_shingles"),
                    F.size(F.array_intersect("grams", "doc_grams")).cast("long").alias("n_common")))
    return (held.where(100 * F.col("n_common") >= percent * F.col("n_item_shingles")).distinct()
            .withColumn("containment", F.col("n_common") / F.col("n_item_shingles")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    leaks = find_leaks(docs, items).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs["doc_id"].cast("long") == F.col("_leak"), "left_anti")
