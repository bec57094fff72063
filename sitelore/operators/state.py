"""Job, course and selection state as derived tables instead of in-place updates.

Counters and statuses are folds over event logs (``job_id, course_id, event_id, ts, event``);
mutations are anti-join + union rewrites; UI selection logic becomes set algebra over
``(course_id, page_id)``. All aggregates are partial (map-side combine), no global windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.functions import rules, urls
from sitelore.operators.ordering import prefix_over
from sitelore.sources.store import BucketTable

NO_PAGES_ERROR = "No pages found for the given IDs"  # fixed value
ALL_FAILED_ERROR = "All pages failed processing"  # fixed value

# Event → course status in the lifecycle log (own mapping of the job event names).
EVENT_STATUS = {"discovered": "discovered", "scraped": "ingested", "failed": "failed",
                "processed": "processed", "generated": "exported"}
SYNC_STATUSES = ["ingested", "failed"]


def job_summary(events: DataFrame) -> DataFrame:
    """Per job: counters, final stage (complete if anything was scraped) and error text."""
    ev = F.col("event")
    agg = events.groupBy("job_id", "course_id").agg(
        F.count_if(ev == "discovered").alias("pages_discovered"),
        F.count_if(ev == "scraped").alias("pages_scraped"),
        F.count_if(ev == "failed").alias("pages_failed"),
        F.count_if(ev == "processed").alias("pages_processed"),
        F.count_if(ev == "generated").alias("files_generated"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("completed_at"),
    )
    no_pages = F.col("pages_discovered") == 0
    return agg.withColumn(
        "current_stage",
        F.when(no_pages, F.lit("failed")).when(F.col("pages_scraped") > 0, F.lit("complete")).otherwise(F.lit("failed")),
    ).withColumn(
        "error",
        F.when(no_pages, F.lit(NO_PAGES_ERROR))
         .when(F.col("pages_failed") > 0, F.concat(F.col("pages_failed").cast("string"), F.lit(" pages failed"))),
    )


def running_progress(events: DataFrame) -> DataFrame:
    """Counters after each event of a job (order ``ts, event_id``), without one task per job."""
    ev = F.col("event")
    out = prefix_over(
        events.select("job_id", "course_id", "event_id", "ts", "event"),
        ["job_id"], ["ts", "event_id"], index_name="seq",
        sums={"scraped": (ev == "scraped").cast("int"), "failed": (ev == "failed").cast("int"),
              "processed": (ev == "processed").cast("int")},
    )
    return out


def latest_job(jobs: DataFrame) -> DataFrame:
    """Newest job per course by ``started_at`` (tie: larger ``job_id``)."""
    cols = [c for c in jobs.columns if c != "course_id"]
    return jobs.groupBy("course_id").agg(
        F.max_by(F.struct(*cols), F.struct("started_at", "job_id")).alias("_j")
    ).select("course_id", *[F.col(f"_j.{c}").alias(c) for c in cols])


def progress_ratio(jobs: DataFrame) -> DataFrame:
    """Scraped share (when anything was discovered) and pipeline position of the stage (failed → -1)."""
    stages = F.array(*[F.lit(s) for s in rules.PIPELINE_STAGES])
    return jobs.select(
        "job_id", "course_id",
        F.when(F.col("pages_discovered") > 0,
               F.try_divide(F.col("pages_scraped").cast("double"), F.col("pages_discovered").cast("double")))
         .alias("scraped_ratio"),
        (F.array_position(stages, F.col("current_stage")) - 1).alias("stage_position"),
    )


def processing_summary(results: DataFrame) -> DataFrame:
    """Per course from per-page results ``(course_id, page_id, ok)``: processed/failed/total and status."""
    agg = results.groupBy("course_id").agg(
        F.count_if(F.col("ok")).alias("processed"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )
    return agg.withColumn("status", F.when(F.col("processed") > 0, F.lit("processed")).otherwise(F.lit("failed"))) \
              .withColumn("error", F.when(F.col("processed") == 0, F.lit(ALL_FAILED_ERROR)))


def status_log(events: DataFrame) -> DataFrame:
    mapping = F.create_map(*[x for k, v in EVENT_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return events.select("course_id", "event_id", "ts", mapping[F.col("event")].alias("status"))


def course_status(log: DataFrame) -> DataFrame:
    """Current status, ``updated_at`` and ``last_synced_at`` (end of an ingestion) per course."""
    synced = F.col("status").isin(SYNC_STATUSES)
    return log.groupBy("course_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(synced, F.col("ts"))).alias("last_synced_at"),
    )


def apply_job_patches(jobs: DataFrame, patches: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Partial updates from a patch log ``(job_id, ts, event_id, patch map<string,string>)``.

    Per column the latest patch that *contains* the key wins, even when it sets NULL on purpose
    (the value is wrapped in a struct, so "no patch" and "patch to NULL" stay distinct).
    ``columns`` maps patched column → its type.
    """
    order = F.struct("ts", "event_id")
    aggs = []
    for col in columns:
        has = F.map_contains_key("patch", col)
        aggs.append(F.max_by(F.struct(F.col("patch")[col].alias("v")), F.when(has, order)).alias(f"_p_{col}"))
    latest = patches.groupBy("job_id").agg(*aggs)
    out = jobs.join(latest, "job_id", "left")
    for col, typ in columns.items():
        out = out.withColumn(col, F.when(F.col(f"_p_{col}").isNotNull(), F.col(f"_p_{col}.v").cast(typ))
                             .otherwise(F.col(col)))
    return out.drop(*[f"_p_{c}" for c in columns])


def upsert_pages(base: DataFrame, new: DataFrame, key: Sequence[str] = ("course_id", "page_id")) -> DataFrame:
    """Replace by site and page id; the new row wins (no cascade to content)."""
    return base.join(new.select(*key), list(key), "left_anti").unionByName(new.select(*base.columns))


def replace_modules(base: DataFrame, new: DataFrame, pages: DataFrame | None = None):
    """Drop every module of the courses present in ``new`` and insert ``new``; pages pointing at a
    dropped module get ``module_id = NULL``. Returns ``modules`` or ``(modules, pages)``."""
    touched = new.select("course_id").distinct()
    modules = base.join(touched, "course_id", "left_anti").unionByName(new.select(*base.columns))
    if pages is None:
        return modules
    live = modules.select("course_id", "module_id", F.lit(True).alias("_live"))
    fixed = pages.join(live, ["course_id", "module_id"], "left").withColumn(
        "module_id", F.when(F.col("_live"), F.col("module_id"))).drop("_live")
    return modules, fixed


def delete_courses(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove courses and cascade: every table loses the rows of the removed courses. Page ids are unique only
    in their site, so a table without ``course_id`` cannot be cascaded to and is an error."""
    bare = [name for name, df in tables.items() if "course_id" not in df.columns]
    if bare:
        raise ValueError(f"tables without course_id: {', '.join(bare)}")
    gone = ids.select("course_id").distinct()
    return {name: df.join(gone, "course_id", "left_anti") for name, df in tables.items()}


def upsert_stored(table: BucketTable, new: DataFrame) -> None:
    """``upsert_pages`` in a stored table: only the hash partitions of the new rows are rewritten."""
    table.upsert(new)


def replace_modules_stored(modules: BucketTable, new: DataFrame, pages: BucketTable | None = None) -> None:
    """``replace_modules`` in stored tables. Applied again it gives the same tables: pages are freed by what the module
    table holds, not by what a run has removed."""
    touched = new.select("course_id").distinct()
    modules.delete(modules.read().join(touched, "course_id", "left_semi").join(
        new.select("course_id", "module_id"), ["course_id", "module_id"], "left_anti"))
    modules.upsert(new)
    if pages is not None:
        held = pages.read().where("module_id IS NOT NULL").join(touched, "course_id", "left_semi")
        lost = held.join(modules.read().select("course_id", "module_id"), ["course_id", "module_id"], "left_anti")
        pages.upsert(lost.withColumn("module_id", F.lit(None).cast("string")))


def delete_stored(tables: dict[str, BucketTable], ids: DataFrame, through_pages: Sequence[str] = ()) -> None:
    """``delete_courses`` in stored tables, all of which carry ``course_id``. The tables named in ``through_pages`` hang on
    their pages (site and page id) and lose what the removed pages held; they go before ``pages``, so a repeat after a run
    that died still finds those pages."""
    for name in through_pages:
        gone = tables["pages"].read().join(ids.select("course_id").distinct(), "course_id", "left_semi")
        tables[name].delete(gone, ["course_id", "page_id"])
    for name, table in tables.items():
        if name not in through_pages:
            table.delete(ids, ["course_id"])


def toggle_pages(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """Symmetric difference of the selection and the toggled page ids (both ``course_id, page_id``)."""
    key = ["course_id", "page_id"]
    return selection.join(ids, key, "left_anti").unionByName(ids.join(selection, key, "left_anti"))


def toggle_modules(selection: DataFrame, module_pages: DataFrame) -> DataFrame:
    """For each toggled module (``course_id, module_id, page_id``): all pages selected → remove them,
    else add them all (an add wins over a remove for a page in two toggled modules)."""
    key = ["course_id", "page_id"]
    marked = module_pages.join(selection.select(*key, F.lit(True).alias("_sel")), key, "left")
    full = marked.groupBy("course_id", "module_id").agg(F.bool_and(F.coalesce("_sel", F.lit(False))).alias("_all"))
    per_page = module_pages.join(full, ["course_id", "module_id"])
    remove = per_page.filter("_all").select(*key)
    add = per_page.filter(~F.col("_all")).select(*key)
    return selection.select(*key).join(remove, key, "left_anti").unionByName(add).distinct()


def all_pages(assigned: DataFrame, unclassified: DataFrame) -> DataFrame:
    """Every page of the course once: union of module pages and unclassified pages."""
    key = ["course_id", "page_id"]
    return assigned.select(*key).unionByName(unclassified.select(*key)).distinct()


def select_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages whose site and id are in ``ids``."""
    key = ["course_id", "page_id"]
    return pages.join(ids.select(*key).distinct(), key, "left_semi")


def list_courses(courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Newest first, and the total as a separate one-row aggregate."""
    return courses.orderBy(F.col("created_at").desc(), F.col("course_id")), courses.agg(F.count(F.lit(1)).alias("total"))


def eligible_courses(courses: DataFrame, action: str) -> DataFrame:
    return courses.filter(F.col("status").isin(rules.ELIGIBLE_STATUSES[action]))


def validate_courses(requests: DataFrame) -> DataFrame:
    """Course requests ``(name, url)`` → ``valid`` and ``reason``; the untrimmed URL is kept."""
    name_len = F.length(F.col("name"))
    trimmed = urls.py_strip(F.col("url"))
    reason = (F.when(F.col("name").isNull() | (name_len < 1), F.lit("name too short"))
               .when(name_len > 500, F.lit("name too long"))
               .when(F.col("url").isNull() | (F.length("url") < 1), F.lit("url empty"))
               .when(~(trimmed.startswith("http://") | trimmed.startswith("https://")),
                     F.lit("url must start with http:// or https://")))
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def filter_content_type(pages: DataFrame, types: Sequence[str]) -> DataFrame:
    return pages.filter(F.col("content_type").isin(list(types)))
