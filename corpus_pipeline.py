"""A corpus pipeline over ``documents``: quality rules, near-duplicate join, suffix-array dedup, benchmark
decontamination, packing. Each stage gets what the one before it kept, as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelore.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup
from sitelore.llm.queries import table
from sitelore.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' production policy keeps; one without text or words fails its least number of words."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows without an id or without
    words stay."""
    return jaccard_join.representatives(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what also stands earlier in the corpus (whole characters only), and n_chars to match; a document
    of which nothing is left goes, one that had no text stays."""
    return suffix_dedup.rewritten(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (of rows that share an id all go); rows without an id or text hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_text),
          ("benchmark decontamination", benchmark), ("packing", pack)]

#: SQL can express neither the byte-wise suffix dedup nor tokenizing and packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name="pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
