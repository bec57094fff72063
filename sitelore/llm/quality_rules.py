"""Quality rules as a bitmask ledger: every rule is evaluated once, its failure is one bit, measurements stay beside it.

Versioned policies are masks over the ledger, so a policy is applied or changed without reading a text again, and
what each rule alone rejects (its ablation) is a bitwise aggregate. Only built-in expressions.

Defined results: null text has no words; a null doc_id and repeated rows are judged each like any other row; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import let
from .texts import words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: rule -> condition under which a document fails; its place is its bit, so new rules go to the end
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
#: versioned policies: the rules whose failure rejects a document
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "production-1": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "word_length"),
}
BIT = {rule: 1 << i for i, rule in enumerate(RULES)}


def mask(policy: str) -> int:
    return sum(BIT[rule] for rule in POLICIES[policy])


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that are found at least twice: windows sorted by hash, equal neighbours kept,
    and their starts, in order, summed up to three words each."""
    windows = let(words, lambda w: F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(3)]).alias("h"), i.alias("at"))))
        .otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    starts = let(F.sort_array(windows), lambda s: F.transform(
        F.filter(s, lambda w, i: w["h"].eqNullSafe(F.get(s, i - 1)["h"]) | w["h"].eqNullSafe(F.get(s, i + 1)["h"])),
        lambda w: w["at"]))
    return F.aggregate(
        F.sort_array(starts), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")),
        lambda acc: acc["n"])


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the MEASURES (columns of those names are replaced)."""
    keep = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(*keep, words_of(text).alias("_words"), F.filter(
        F.split(text, "\n"), lambda line: line.rlike("[^ \\x09-\\x0D]")).alias("_lines"))
    return words.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_words")).alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the MEASURES and ``bits`` (long): bit i is set if the i-th rule fails."""
    bits = F.lit(0).cast("long")
    for rule, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[rule])).otherwise(F.lit(0)).cast("long"))
    return measure(docs.select("doc_id", "text")).select("doc_id", *MEASURES, bits.alias("bits"))


def rejected(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and that it alone rejects (kept without it); one row a rule,
    with the bits that any and all documents fail."""
    rules = POLICIES[policy]
    hit = F.col("bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sums = book.agg(
        F.bit_or("bits").alias("any_bits"), F.bit_and("bits").alias("all_bits"),
        *[F.count_if(F.col("bits").bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias(f"fails_{r}") for r in rules],
        *[F.count_if(hit == F.lit(BIT[r])).alias(f"alone_{r}") for r in rules])
    return sums.select("any_bits", "all_bits", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"fails_{r}").alias("fails"), F.col(f"alone_{r}").alias("alone"))
        for r in rules])).alias("r")).select("r.rule", "r.fails", "r.alone", "any_bits", "all_bits")


def judge(docs: DataFrame, policy: str = "production-1") -> DataFrame:
    """doc_id, the MEASURES, bits, base_failed and kept (false if base_failed, else the policy's verdict)."""
    base = rejected(F.col("bits"), "base-1")
    return ledger(docs).select("*", base.alias("base_failed"), (~base & ~rejected(F.col("bits"), policy)).alias("kept"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "bits")


def passing(docs: DataFrame, policy: str = "production-1") -> DataFrame:
    """The rows of ``docs``, with all their columns, that a policy keeps."""
    judged = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text"))
    bits = F.lit(0).cast("long")
    for rule in POLICIES["base-1"] + POLICIES[policy]:
        bits = bits.bitwiseOR(F.when(F.expr(RULES[rule]), F.lit(BIT[rule])).otherwise(F.lit(0)).cast("long"))
    return measure(judged).where(bits == 0).select("_row.*")
