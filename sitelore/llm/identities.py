"""Which rows are one document: those with one doc_id and one text (a null text is empty).

Operators that join their findings back to the rows do so by KEY. That is the doc_id, unless some doc_id stands on
different texts: then documents are numbered by (doc_id, SHA-256 of the text) over all tasks, the rows are written once
with their numbers, and numbers turn into ids again in the result. Numbers rise with doc_id, so the smallest number of a
group has the smallest id. Rows without an id have no key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import prefix_over
from ..session import cut_lineage

KEY = "_sitelore_document"


def numbered(docs: DataFrame) -> DataFrame | None:
    """own_id, version and number of every document, or None if no doc_id has different texts."""
    rows = (docs.select(F.col("doc_id").cast("long").alias("own_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("own_id IS NOT NULL"))
    marks = rows.select("own_id", F.xxhash64("text").alias("mark")).groupBy("own_id").agg(
        F.min("mark").alias("low"), F.max("mark").alias("high"))
    if marks.where("low <> high").isEmpty():
        return None
    versions = rows.select("own_id", F.sha2("text", 256).alias("version")).distinct()
    return cut_lineage(prefix_over(versions, [], ["own_id", "version"], "number"), name="documents")


def with_key(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``docs`` with the column KEY, and the table of numbers (None: KEY is the doc_id)."""
    own, numbers = docs["doc_id"].cast("long"), numbered(docs)
    if numbers is None:
        return docs.withColumn(KEY, own), None
    version = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    keyed = docs.join(numbers, (own == numbers["own_id"]) & (version == numbers["version"]), "left").select(
        docs["*"], numbers["number"].alias(KEY))
    return cut_lineage(keyed, name="keyed"), numbers


def by_key(rows: DataFrame) -> DataFrame:
    """doc_id and text, with the key as doc_id."""
    return rows.select(F.col(KEY).alias("doc_id"), F.col("text").cast("string").alias("text"))


def own_ids(result: DataFrame, numbers: DataFrame | None, names: Iterable[str]) -> DataFrame:
    """``result`` with the doc_id of each number in the columns ``names``."""
    if numbers is None:
        return result
    columns = result.columns
    for name in names:
        ids = numbers.select(F.col("number").alias(name), F.col("own_id").alias("_own"))
        result = result.join(ids, name, "left").drop(name).withColumnRenamed("_own", name)
    return result.select(*columns)
