"""Site hierarchy: modules and the pages they contain, for every site at once.

Pages schema: ``course_id, page_id, url, title, content_type`` (output of ``discover_pages``).
A site with at least one ``module`` page uses those pages as containers (prefix match on the
URL path); any other site gets modules detected from its URL directories.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from sitelore.functions import urls
from sitelore.operators.ordering import prefix_over
from sitelore.session import cut_lineage

PAGE_COLS = ["page_id", "url", "title", "content_type"]


def module_flags(pages: DataFrame) -> DataFrame:
    """One row per site: does it have an explicit module page? (partial aggregate, tiny output)"""
    return pages.groupBy("course_id").agg(F.bool_or(F.col("content_type") == "module").alias("has_modules"))


def order_module_pages(pages: DataFrame) -> DataFrame:
    """Explicit modules ordered by ``(url, title or '')``; ``order_index`` from 0; title default ``Module i``."""
    mods = pages.filter(F.col("content_type") == "module").select(
        "course_id", "page_id", "url", "title",
        F.regexp_replace(urls.url_path(F.col("url")), "/+$", "").alias("module_path"))
    ranked = prefix_over(mods, ["course_id"], ["url", F.coalesce("title", F.lit("")), "page_id"], "order_index")
    return ranked.select(
        "course_id",
        F.col("page_id").cast("string").alias("module_id"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")),
                   F.concat(F.lit("Module "), (F.col("order_index") + 1).cast("string"))).alias("module_title"),
        "order_index",
        "module_path",
    )


def assign_pages_by_prefix(pages: DataFrame, modules: DataFrame) -> DataFrame:
    """Content pages → every explicit module whose path equals the page path or is a '/'-prefix of it.

    A sweep over nested intervals: modules and pages are range-partitioned and sorted once by site and path segments,
    where a module's pages follow it without a gap, and a task walks its range with a stack of the modules it is
    inside of. One row a page is shuffled, whatever its depth, and a hot site is split like any other. The modules that
    a range starts inside of are ancestors of its first row: those are looked up afterwards, for one row a range, and
    joined to the range's pages (at most path depth rows a range).
    """
    content = pages.filter(F.col("content_type") != "module").select(
        "course_id", *PAGE_COLS, F.regexp_replace(urls.url_path(F.col("url")), "/+$", "").alias("path"),
        F.lit(1).alias("kind"))
    heads = modules.select("course_id", "module_id", "module_title", "order_index", F.col("module_path").alias("path"),
                           F.lit(0).alias("kind"))
    swept = swept_ranges(content.unionByName(heads, allowMissingColumns=True))
    module = F.struct("module_id", "module_title", F.col("order_index").cast("bigint").alias("order_index"))
    own = swept.filter("kind = 1").withColumn("m", F.explode("inside"))
    # what a range starts inside of: modules of an earlier range on the path of its first row
    first = swept.groupBy("range").agg(F.min_by(F.struct("course_id", "path"), "at").alias("f")).select(
        "range", "f.course_id", F.explode(F.array_distinct(urls.path_prefixes(F.col("f.path")))).alias("path"))
    found = swept.filter("kind = 0").select("course_id", "path", module.alias("m"), F.col("range").alias("of"))
    carried = first.join(found, ["course_id", "path"]).filter("of < range").select(
        "range", "course_id", F.col("path").alias("module_path"), "m")
    below = (F.col("path") == F.col("module_path")) | F.col("path").startswith(F.concat("module_path", F.lit("/")))
    inherited = swept.filter("kind = 1").join(carried, ["range", "course_id"]).filter(below)
    columns = ["course_id", *PAGE_COLS, "m.module_id", "m.module_title", "m.order_index"]
    return own.select(*columns).unionAll(inherited.select(*columns))


def swept_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (course_id, path, kind 0 for modules and 1 for pages) written in ranges of (site, path segments), with
    ``range``, their place ``at`` and, for pages, the modules of the same range that they are ``inside`` of."""
    order = [F.col("course_id"), F.split("path", "/"), F.col("kind"), F.col("order_index"), F.col("page_id")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33))
    module = pa.struct([("module_id", pa.string()), ("module_title", pa.string()), ("order_index", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, stack = None, []
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)).to_pylist()
                       for c in ("course_id", "path", "kind", "module_id", "module_title", "order_index")]
            inside = []
            for course, path, kind, *head in zip(*columns):
                if course != site:
                    site, stack = course, []
                while stack and not (path == stack[-1][0] or path.startswith(stack[-1][1])):
                    stack.pop()
                if kind == 0:
                    stack.append((path, path + "/", dict(zip(("module_id", "module_title", "order_index"), head))))
                    inside.append([])
                else:
                    inside.append([m for _, _, m in stack])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.list_(module))],
                                             names=[*names, "inside"])

    schema = StructType([*sorted_rows.schema.fields]).add("inside", ArrayType(StructType().add("module_id", "string").add(
        "module_title", "string").add("order_index", "long")))
    return cut_lineage(sorted_rows.mapInArrow(run, schema), name="swept")


def detect_modules(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules from URL directories (sites without explicit module pages).

    Key = second-to-last non-empty path segment, ``_root`` for shallower paths. ``order_index``
    is the rank among all keys of the site; ``_root`` is dropped when other keys exist.
    Returns ``(modules, assignments)``.
    """
    with_path = pages.withColumn("_segs", urls.path_segments(F.col("url")))
    segs = F.col("_segs")
    keyed = with_path.withColumn(
        "module_key", F.when(F.size(segs) >= 2, F.element_at(segs, -2)).otherwise(F.lit("_root"))).drop("_segs")
    keys = keyed.groupBy("course_id", "module_key").agg(F.count(F.lit(1)).alias("n_pages"))
    n_keys = keys.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_keys"))
    ranked = prefix_over(keys, ["course_id"], ["module_key"], "order_index").join(n_keys, "course_id")
    modules = ranked.filter((F.col("module_key") != "_root") | (F.col("n_keys") == 1)).select(
        "course_id",
        F.concat(F.col("course_id"), F.lit("/"), F.col("module_key")).alias("module_id"),
        urls.humanize_segment(F.col("module_key")).alias("module_title"),
        "order_index",
        "module_key",
    )
    assigned = keyed.join(modules, ["course_id", "module_key"]).select(
        "course_id", *PAGE_COLS, "module_id", "module_title", "order_index")
    return modules.drop("module_key"), assigned


def build_modules_and_assignments(pages: DataFrame, materialize=None) -> tuple[DataFrame, DataFrame]:
    """Per site pick the explicit or the detected branch. Returns ``(modules, assignments)``.

    ``materialize`` (e.g. ``session.cut_lineage``) is applied to the module tables that are read
    twice (once as output, once to assign pages), so the plan does not re-derive them.
    """
    materialize = materialize or (lambda df: df)
    flagged = pages.join(module_flags(pages), "course_id")
    explicit_pages = flagged.filter("has_modules").drop("has_modules")
    detect_input = flagged.filter(~F.col("has_modules")).drop("has_modules")
    ex_modules = materialize(order_module_pages(explicit_pages))
    ex_assigned = assign_pages_by_prefix(explicit_pages, ex_modules)
    de_modules, de_assigned = detect_modules(detect_input)
    modules = ex_modules.drop("module_path").unionByName(de_modules)
    return materialize(modules), materialize(ex_assigned.unionByName(de_assigned))


def unclassified_pages(pages: DataFrame, assigned: DataFrame) -> DataFrame:
    """Pages in no module (explicit module landing pages included)."""
    return pages.join(assigned.select("course_id", "page_id"), ["course_id", "page_id"], "left_anti")


def build_hierarchy(pages: DataFrame, materialize=None) -> DataFrame:
    """Flat hierarchy: one row per (module, page) assignment, a page-less row for an empty
    module, and one row with null module for each unclassified page."""
    modules, assigned = build_modules_and_assignments(pages, materialize)
    mod_rows = modules.join(assigned.drop("module_title", "order_index"), ["course_id", "module_id"], "left")
    uncl = unclassified_pages(pages, assigned).select(
        "course_id", F.lit(None).cast("string").alias("module_id"), F.lit(None).cast("string").alias("module_title"),
        F.lit(None).cast("bigint").alias("order_index"), *PAGE_COLS)
    return mod_rows.select("course_id", "module_id", "module_title", "order_index", *PAGE_COLS).unionByName(uncl)


def course_counts(hierarchy: DataFrame) -> DataFrame:
    """module_count and page_count (multi-assigned pages counted once per module, plus unclassified)."""
    return hierarchy.groupBy("course_id").agg(
        F.count_distinct("module_id").alias("module_count"),
        F.count("page_id").alias("page_count"),
    )


def store_pages(pages: DataFrame, assigned: DataFrame) -> DataFrame:
    """Pages table as stored: one module per page, the last one written (highest ``order_index``)."""
    last = assigned.groupBy("course_id", "page_id").agg(
        F.max_by("module_id", F.struct("order_index", "module_id")).alias("module_id"))
    return pages.join(last, ["course_id", "page_id"], "left").select(
        "course_id", "page_id", "module_id", "url", "title", "content_type",
        F.lit("discovered").alias("status"))


def course_structure(modules: DataFrame, stored_pages: DataFrame) -> DataFrame:
    """Tree from stored tables, flat: module rows joined to their pages, plus unclassified pages."""
    mod_rows = modules.select("course_id", "module_id", "module_title", "order_index").join(
        stored_pages.filter(F.col("module_id").isNotNull()).drop("status"), ["course_id", "module_id"], "left")
    uncl = stored_pages.filter(F.col("module_id").isNull()).select(
        "course_id", "module_id", F.lit(None).cast("string").alias("module_title"),
        F.lit(None).cast("bigint").alias("order_index"), *PAGE_COLS)
    return mod_rows.select("course_id", "module_id", "module_title", "order_index", *PAGE_COLS).unionByName(uncl)
