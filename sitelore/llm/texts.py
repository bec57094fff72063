"""Shared helpers: text columns as bytes inside tasks, word splits, native word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import let

#: separators of a plain word: [\x20\x09-\x0D]+ ; of an alphanumeric one: other ASCII than 0-9 and a-z
SPACES = "[ \\x09-\\x0D]+"
NON_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column, separators: str = SPACES) -> Column:
    """The maximal runs between separators as an array (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def grams_of(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` words, in order; empty for fewer than ``k`` words. The words are bound once
    (``let``): an expression named inside the lambda would be evaluated for every element."""
    return let(words, lambda w: F.when(
        F.size(w) >= k,
        F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(k)),
                    lambda i: F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>")))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read, under their own names (extra columns cannot clash)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def byte_columns(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes of all rows, offsets); null rows are empty."""
    array = pc.fill_null(array, "") if array.null_count else array
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def give_back() -> None:
    """Memory that this worker has freed goes back to the system; while it idles for a later stage, it would hold it."""
    pa.default_memory_pool().release_unused()


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (one row if that is longer)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to
