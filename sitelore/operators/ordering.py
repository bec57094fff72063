"""Order-dependent numbering and running totals that never route a whole group through one task.

``row_number()`` / ``sum() OVER (... ROWS UNBOUNDED PRECEDING)`` partitioned by a site or a job
would send every row of that key to one task; one site may hold a third of all rows. Here
rows are range-partitioned on ``(keys, order)``, sorted and written once with their place
(task and row). Everything after reads that table, so the slices it numbers and the slice
table that supplies their offsets (at most #keys + #partitions rows) cannot disagree,
whatever is re-planned or retried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelore.session import cut_lineage


def _cols(xs: Sequence[Column | str]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def prefix_over(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    index_name: str | None = "idx",
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Add a 0-based ``index_name`` within ``keys`` in ``order`` and inclusive running sums.

    ``order`` must be a total order inside each key (add a unique tie-breaker). NULL is a key
    like any other.
    """
    sums = sums or {}
    ordered = [*_cols(keys), *_cols(order)]
    staged = df
    for name, expr in sums.items():
        staged = staged.withColumn(f"_v_{name}", expr.cast("bigint"))
    # monotonically_increasing_id: task number << 33 | row in the task
    placed = cut_lineage(
        staged.repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn(
            "_at", F.monotonically_increasing_id()), name="ordered")
    placed = placed.withColumn("_pid", F.shiftright("_at", 33))

    slices = placed.groupBy("_pid", *keys).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        F.col("_pid").alias("_o_pid"), *[F.col(k).alias(f"_o_{k}") for k in keys], "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    out = placed
    if sums:
        local = (Window.partitionBy("_pid", *keys).orderBy("_at")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        for name in sums:
            out = out.withColumn(f"_lv_{name}", F.sum(f"_v_{name}").over(local))
    match = F.col("_pid") == F.col("_o_pid")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    out = out.join(offsets, match)
    added = []
    if index_name:
        added.append((F.col("_off_n") + F.col("_at") - F.col("_first")).cast("bigint").alias(index_name))
    added += [(F.col(f"_off_{n}") + F.coalesce(f"_lv_{n}", F.lit(0))).cast("bigint").alias(n) for n in sums]
    return out.select(*df.columns, *added)
