"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables of ``sf_dir`` (or fixtures Spark derives from them), runs
over whole tables and returns a flat DataFrame whose column names match the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.functions import rules, urls
from sitelore.operators import frontier
from sitelore.session import cut_lineage, ensure_checkpoint_dir
from sitelore.sources.fixtures import tables
from sitelore.sources.store import BucketTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def prepare_session(spark: SparkSession) -> None:
    """Session settings the queries rely on: the shared checkpoint folder (only created when
    ``spark.checkpoint.dir`` is unset) and no constraint propagation (it grows exponentially on
    the long alias chains of the URL split; the filters it would infer are not needed)."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")


def register(name: str):
    def deco(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf_dir)
        query.__name__ = getattr(fn, "__name__", name)
        query.__doc__ = fn.__doc__
        QUERIES[name] = query
        return fn
    return deco


# ---------------------------------------------------------------- shared stages
def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return frontier.discover_pages(t["links"], t["courses"])


_STAGES: dict[tuple, DataFrame] = {}
REUSE_STAGES = True


def stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A pipeline stage table: built by Spark once, written to the shared checkpoint folder, and
    read back by every later query of the same session (like a stored table between jobs)."""
    key = _stage_key(spark, sf_dir, name)
    if not REUSE_STAGES or key not in _STAGES:
        _STAGES[key] = cut_lineage(build(), spark, name=name)
    return _STAGES[key]


def _stage_key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """A stage belongs to one application and one state of the input files (paths, sizes, times)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    state = []
    while files.hasNext():
        f = files.next()
        state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.sparkContext.applicationId, sf_dir, hash(tuple(sorted(state))), name


def reset_stages() -> None:
    _STAGES.clear()


def discovered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered pages written once to the shared checkpoint folder (the stored pages table);
    queries that read pages several times (self-joins) start from it instead of re-deriving."""
    return stage(spark, sf_dir, "discovered_pages", lambda: discovered(spark, sf_dir))


# ---------------------------------------------------------------- 2.2 scalar expressions
@register("url_parts")
def q_url_parts(spark, sf_dir):
    links = tables(spark, sf_dir)["links"]
    return links.select("course_id", "ord", urls.url_parts(F.col("url")).alias("p")).select("course_id", "ord", "p.*")


@register("base_domain")
def q_base_domain(spark, sf_dir):
    links = tables(spark, sf_dir)["links"]
    return links.select("course_id", "ord", urls.base_domain(F.col("url")).alias("base_domain"))


@register("canonical_url")
def q_canonical_url(spark, sf_dir):
    links = tables(spark, sf_dir)["links"]
    return links.select("course_id", "ord", urls.canonical_url(urls.py_strip(F.col("url"))).alias("canonical"))


@register("title_from_url")
def q_title_from_url(spark, sf_dir):
    links = tables(spark, sf_dir)["links"]
    return links.select("course_id", "ord", urls.title_from_url(F.col("url")).alias("url_title"))


@register("is_relevant")
def q_is_relevant(spark, sf_dir):
    t = tables(spark, sf_dir)
    fr = frontier.with_course_base(frontier.prepare_frontier(t["links"]), t["courses"])
    return fr.select("course_id", "ord", frontier.relevance_flag(fr).alias("relevant"))


@register("classify_content_type")
def q_classify(spark, sf_dir):
    links = tables(spark, sf_dir)["links"]
    return links.select("course_id", "ord",
                        rules.classify_content_type(F.col("url"), F.col("title")).alias("content_type"))


# ---------------------------------------------------------------- 2.5 / 2.4 frontier
@register("dedupe_links")
def q_dedupe_links(spark, sf_dir):
    links = tables(spark, sf_dir)["links"]
    return frontier.dedupe_links(frontier.prepare_frontier(links)).select("course_id", "canonical", "ord", "url", "title")


@register("discover_pages")
def q_discover_pages(spark, sf_dir):
    return discovered(spark, sf_dir)


@register("discovery_stats")
def q_discovery_stats(spark, sf_dir):
    t = tables(spark, sf_dir)
    return frontier.discovery_stats(t["links"], t["courses"])


@register("limit_frontier")
def q_limit_frontier(spark, sf_dir):
    links = tables(spark, sf_dir)["links"]
    return frontier.limit_frontier(links, 20)


# ---------------------------------------------------------------- 2.3 / 2.4 / 2.8 hierarchy
from sitelore.operators import hierarchy  # noqa: E402


def explicit_pages(pages: DataFrame) -> DataFrame:
    return pages.join(hierarchy.module_flags(pages).filter("has_modules"), "course_id", "left_semi")


def detect_pages(pages: DataFrame) -> DataFrame:
    return pages.join(hierarchy.module_flags(pages).filter(~F.col("has_modules")), "course_id", "left_semi")


@register("order_module_pages")
def q_order_module_pages(spark, sf_dir):
    return hierarchy.order_module_pages(explicit_pages(discovered_table(spark, sf_dir)))


@register("assign_pages_by_prefix")
def q_assign_pages_by_prefix(spark, sf_dir):
    pages = explicit_pages(discovered_table(spark, sf_dir))
    return hierarchy.assign_pages_by_prefix(pages, hierarchy.order_module_pages(pages))


@register("detect_modules")
def q_detect_modules(spark, sf_dir):
    modules, _ = hierarchy.detect_modules(detect_pages(discovered_table(spark, sf_dir)))
    return modules


@register("unclassified_pages")
def q_unclassified_pages(spark, sf_dir):
    pages = discovered_table(spark, sf_dir)
    _, assigned = hierarchy.build_modules_and_assignments(pages, cut_lineage)
    return hierarchy.unclassified_pages(pages, assigned)


@register("build_hierarchy")
def q_build_hierarchy(spark, sf_dir):
    return hierarchy.build_hierarchy(discovered_table(spark, sf_dir), cut_lineage)


@register("course_counts")
def q_course_counts(spark, sf_dir):
    return hierarchy.course_counts(hierarchy.build_hierarchy(discovered_table(spark, sf_dir), cut_lineage))


@register("course_structure")
def q_course_structure(spark, sf_dir):
    pages = discovered_table(spark, sf_dir)
    modules, assigned = hierarchy.build_modules_and_assignments(pages, cut_lineage)
    return hierarchy.course_structure(modules, hierarchy.store_pages(pages, assigned))


# ---------------------------------------------------------------- 2.1 sources + content
from sitelore.operators import content as contentops  # noqa: E402
from sitelore.sources import html, payloads  # noqa: E402


@register("extract_links")
def q_extract_links(spark, sf_dir):
    return html.extract_links(tables(spark, sf_dir)["pages"])


@register("extract_content")
def q_extract_content(spark, sf_dir):
    out = html.extract_content(tables(spark, sf_dir)["pages"])
    return out.select("page_id", "url", "title", "markdown", F.col("metadata")["language"].alias("lang"),
                      F.col("metadata")["source_url"].alias("source_url"), "success")


@register("normalize_links")
def q_normalize_links(spark, sf_dir):
    return payloads.normalize_links(tables(spark, sf_dir)["map_payloads"])


@register("normalize_scrape_payload")
def q_normalize_scrape_payload(spark, sf_dir):
    out = payloads.normalize_scrape_payload(tables(spark, sf_dir)["scrape_payloads"])
    return out.select("course_id", "ord", "url", "markdown", "title",
                      F.col("metadata")["source_url"].alias("source_url"),
                      F.col("metadata")["title"].alias("meta_title"),
                      F.size("metadata").cast("bigint").alias("n_meta"), "success")


@register("normalize_crawl_payload")
def q_normalize_crawl_payload(spark, sf_dir):
    return payloads.normalize_crawl_payload(tables(spark, sf_dir)["crawl_payloads"])


def fingerprinted(spark, sf_dir) -> DataFrame:
    return contentops.content_fingerprint(tables(spark, sf_dir)["content"])


def known_and_new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = fingerprinted(spark, sf_dir)
    return c.filter(F.col("page_id") % 2 == 0), c.filter(F.col("page_id") % 2 != 0)


def content_store(spark, sf_dir, shared: bool = True) -> contentops.ContentStore:
    """The store of known content, made once a session unless it is to be changed."""
    key = _stage_key(spark, sf_dir, "content_store")
    if not (shared and REUSE_STAGES and key in _STAGES):
        known, _ = known_and_new(spark, sf_dir)
        made = contentops.ContentStore.create(known, _fresh(spark, "stores/content"))
        if not shared:
            return made
        _STAGES[key] = made
    return _STAGES[key]


@register("content_fingerprint")
def q_content_fingerprint(spark, sf_dir):
    return fingerprinted(spark, sf_dir).select("page_id", "url", "content_hash", "file_key")


@register("cache_split")
def q_cache_split(spark, sf_dir):
    _, new = known_and_new(spark, sf_dir)
    return content_store(spark, sf_dir).split(new.select("course_id", "page_id", "url"))


@register("drop_known_content")
def q_drop_known_content(spark, sf_dir):
    _, new = known_and_new(spark, sf_dir)
    return content_store(spark, sf_dir).unknown(new).select("page_id", "url", "content_hash")


@register("latest_scrape")
def q_latest_scrape(spark, sf_dir):
    every = contentops.ContentStore.create(fingerprinted(spark, sf_dir), _fresh(spark, "stores/content"))
    return every.latest().select("page_id", "course_id", "url", "retrieved_at", "content_hash")


@register("upsert_content")
def q_upsert_content(spark, sf_dir):
    _, new = known_and_new(spark, sf_dir)
    store = content_store(spark, sf_dir, shared=False)
    store.upsert(new)
    return store.table.read().select("page_id", "course_id", "url", "content_hash", "retrieved_at")


@register("content_timeline")
def q_content_timeline(spark, sf_dir):
    c = tables(spark, sf_dir)["content"].select("course_id", "retrieved_at", "page_id", "url")
    return contentops.content_timeline(c)


# ---------------------------------------------------------------- 2.4-2.7 state, mutations, selections
from sitelore.operators import state  # noqa: E402

PATCH_COLUMNS = {"current_stage": "string", "pages_scraped": "bigint", "error": "string", "files_generated": "bigint"}


def job_patches(events: DataFrame) -> DataFrame:
    """Patch log derived from the job events (each event patches some job fields)."""
    ev, eid = F.col("event"), F.col("event_id")
    patch = (F.when(ev == "discovered", F.create_map(F.lit("current_stage"), F.lit("scraping")))
              .when(ev == "scraped", F.create_map(F.lit("pages_scraped"), (eid % 100).cast("string")))
              .when(ev == "failed", F.create_map(F.lit("error"), F.concat(F.lit("event "), eid.cast("string"))))
              .when(ev == "processed", F.create_map(F.lit("error"), F.lit(None).cast("string"),
                                                    F.lit("current_stage"), F.lit("processing")))
              .otherwise(F.create_map(F.lit("files_generated"), (eid % 7).cast("string"),
                                      F.lit("current_stage"), F.lit("complete"))))
    return events.select("job_id", "ts", "event_id", patch.alias("patch"))


def jobs(spark, sf_dir) -> DataFrame:
    return state.job_summary(tables(spark, sf_dir)["job_events"])


@register("job_summary")
def q_job_summary(spark, sf_dir):
    return jobs(spark, sf_dir)


@register("running_progress")
def q_running_progress(spark, sf_dir):
    return state.running_progress(tables(spark, sf_dir)["job_events"])


@register("latest_job")
def q_latest_job(spark, sf_dir):
    return state.latest_job(jobs(spark, sf_dir).select("job_id", "course_id", "started_at", "current_stage"))


@register("progress_ratio")
def q_progress_ratio(spark, sf_dir):
    return state.progress_ratio(jobs(spark, sf_dir))


@register("course_status")
def q_course_status(spark, sf_dir):
    return state.course_status(state.status_log(tables(spark, sf_dir)["job_events"]))


@register("apply_job_patches")
def q_apply_job_patches(spark, sf_dir):
    t = tables(spark, sf_dir)
    base = state.job_summary(t["job_events"]).select("job_id", "course_id", *PATCH_COLUMNS)
    return state.apply_job_patches(base, job_patches(t["job_events"]), PATCH_COLUMNS)


@register("upsert_pages")
def q_upsert_pages(spark, sf_dir):
    pages = discovered(spark, sf_dir).withColumn("status", F.lit("discovered"))
    new = pages.filter(F.col("page_id") % 5 == 0).withColumn("title", F.concat("title", F.lit(" (rev)"))).withColumn(
        "status", F.lit("scraped"))
    table = BucketTable.create(pages, _fresh(spark, "stores/pages"), ["course_id", "page_id"])
    state.upsert_stored(table, new)
    return table.read()


@register("rediscover_pages")
def q_rediscover_pages(spark, sf_dir):
    """The frontier mapped again: every position is shifted, each 40th block of links is gone, each 30th title is new."""
    t = tables(spark, sf_dir)
    block = F.floor(F.col("ord") / 8)
    again = t["links"].filter(block % 40 != 7).withColumn(
        "title", F.when(block % 30 == 4, F.concat(F.lit("Again "), block.cast("string"))).otherwise(F.col("title"))).withColumn(
        "ord", F.when(block % 5 == 0, F.col("ord")).otherwise(F.col("ord") + 3))
    earlier = t["links"].filter(block % 50 != 9)
    before, after = (frontier.discover_pages(x, t["courses"], stable_ids=True, with_ord=True) for x in (earlier, again))
    diff = frontier.rediscover(before, after)
    return diff.select("course_id", "canonical", "change", "url", "title", "content_type", "old_ord", "new_ord")


def hierarchy_tables(spark, sf_dir):
    pages = discovered_table(spark, sf_dir)

    def build():
        return hierarchy.build_modules_and_assignments(pages, cut_lineage)

    keys = _stage_key(spark, sf_dir, "modules"), _stage_key(spark, sf_dir, "assigned")
    if keys[0] not in _STAGES or not REUSE_STAGES:
        _STAGES[keys[0]], _STAGES[keys[1]] = build()
    return pages, _STAGES[keys[0]], _STAGES[keys[1]]


@register("replace_modules")
def q_replace_modules(spark, sf_dir):
    _, modules, _ = hierarchy_tables(spark, sf_dir)
    courses = tables(spark, sf_dir)["courses"]
    even = courses.filter(F.substring("course_id", 2, 20).cast("bigint") % 2 == 0)
    new = even.select("course_id", F.concat("course_id", F.lit("/replaced")).alias("module_id"),
                      F.lit("Replaced").alias("module_title"), F.lit(0).cast("bigint").alias("order_index"))
    table = BucketTable.create(modules, _fresh(spark, "stores/modules"), ["course_id", "module_id"])
    state.replace_modules_stored(table, new)
    return table.read()


@register("replace_modules_pages")
def q_replace_modules_pages(spark, sf_dir):
    pages, modules, assigned = hierarchy_tables(spark, sf_dir)
    new = tables(spark, sf_dir)["courses"].filter(F.substring("course_id", 2, 20).cast("bigint") % 2 == 0).select(
        "course_id", F.concat("course_id", F.lit("/replaced")).alias("module_id"),
        F.lit("Replaced").alias("module_title"), F.lit(0).cast("bigint").alias("order_index"))
    table = BucketTable.create(modules, _fresh(spark, "stores/modules"), ["course_id", "module_id"])
    stored = BucketTable.create(hierarchy.store_pages(pages, assigned), _fresh(spark, "stores/pages"), ["course_id", "page_id"])
    state.replace_modules_stored(table, new, stored)
    return stored.read().select("course_id", "page_id", "module_id")


def _deleted_ids(spark, sf_dir) -> DataFrame:
    courses = tables(spark, sf_dir)["courses"]
    return courses.filter(F.substring("course_id", 2, 20).cast("bigint") % 4 == 1).select("course_id")


@register("delete_courses")
def q_delete_courses(spark, sf_dir):
    key = ["course_id", "page_id"]
    rows = tables(spark, sf_dir)["page_content"].select(*key, "url")
    content = BucketTable.create(rows, _fresh(spark, "stores/page_content"), key)
    pages = BucketTable.create(discovered(spark, sf_dir), _fresh(spark, "stores/pages"), key)
    state.delete_stored({"pages": pages, "content": content}, _deleted_ids(spark, sf_dir), through_pages=["content"])
    return content.read().select("page_id", "url")


@register("delete_courses_pages")
def q_delete_courses_pages(spark, sf_dir):
    table = BucketTable.create(discovered(spark, sf_dir), _fresh(spark, "stores/pages"), ["course_id", "page_id"])
    state.delete_stored({"pages": table}, _deleted_ids(spark, sf_dir))
    return table.read().select("course_id", "page_id", "url")


@register("toggle_pages")
def q_toggle_pages(spark, sf_dir):
    sel = tables(spark, sf_dir)["selection"]
    ids = discovered(spark, sf_dir).filter(F.col("page_id") % 5 == 0).select("course_id", "page_id")
    return state.toggle_pages(sel, ids)


@register("toggle_modules")
def q_toggle_modules(spark, sf_dir):
    _, modules, assigned = hierarchy_tables(spark, sf_dir)
    toggled = modules.filter(F.col("order_index") == 0).select("course_id", "module_id")
    module_pages = assigned.join(toggled, ["course_id", "module_id"], "left_semi").select(
        "course_id", "module_id", "page_id")
    return state.toggle_modules(tables(spark, sf_dir)["selection"], module_pages)


@register("all_pages")
def q_all_pages(spark, sf_dir):
    pages, _, assigned = hierarchy_tables(spark, sf_dir)
    return state.all_pages(assigned, hierarchy.unclassified_pages(pages, assigned))


@register("select_pages")
def q_select_pages(spark, sf_dir):
    return state.select_pages(discovered(spark, sf_dir), tables(spark, sf_dir)["selection"])


@register("list_courses")
def q_list_courses(spark, sf_dir):
    ordered, _ = state.list_courses(tables(spark, sf_dir)["courses"])
    return ordered


@register("list_courses_total")
def q_list_courses_total(spark, sf_dir):
    _, total = state.list_courses(tables(spark, sf_dir)["courses"])
    return total


@register("eligible_courses")
def q_eligible_courses(spark, sf_dir):
    courses = tables(spark, sf_dir)["courses"]
    parts = [state.eligible_courses(courses, a).select("course_id", F.lit(a).alias("action"))
             for a in ("open", "process", "export")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("validate_courses")
def q_validate_courses(spark, sf_dir):
    req = tables(spark, sf_dir)["links"].select("course_id", "ord", F.col("title").alias("name"), "url")
    return state.validate_courses(req).select("course_id", "ord", "valid", "reason")


@register("filter_content_type")
def q_filter_content_type(spark, sf_dir):
    pages = discovered(spark, sf_dir)
    quiz = state.filter_content_type(pages, ["quiz"]).withColumn("bucket", F.lit("quiz"))
    work = state.filter_content_type(pages, ["assignment", "project"]).withColumn("bucket", F.lit("assignment"))
    return quiz.unionByName(work).select("course_id", "page_id", "content_type", "bucket")


# ---------------------------------------------------------------- 2.2 / 2.10 structuring
from sitelore.operators import structure  # noqa: E402


def stored_tables(spark, sf_dir):
    """Stored pages (one module per page), modules and courses of the discovery stage."""
    pages, modules, assigned = hierarchy_tables(spark, sf_dir)
    return hierarchy.store_pages(pages, assigned), modules, tables(spark, sf_dir)["courses"]


def enriched(spark, sf_dir) -> DataFrame:
    pages, modules, courses = stored_tables(spark, sf_dir)
    return structure.enrich_context(tables(spark, sf_dir)["page_content"], pages, modules, courses)


def joined(arr_col) -> "F.Column":
    return F.array_join(arr_col, "|")


def record_view(df: DataFrame) -> DataFrame:
    """Flat view of a structured record for comparison."""
    s = F.col("structured")
    return df.select(
        "page_id", "ok", "error", s["title"].alias("title"), s["course"].alias("course"), s["module"].alias("module"),
        s["content_type"].alias("content_type"), s["summary"].alias("summary"), s["source_url"].alias("source_url"),
        joined(s["key_concepts"]).alias("key_concepts"), joined(s["learning_objectives"]).alias("objectives"),
        joined(s["quiz_topics"]).alias("quiz_topics"),
        joined(F.transform(s["definitions"], lambda e: F.concat(F.coalesce(e["term"], F.lit("")), F.lit("="),
                                                                F.coalesce(e["definition"], F.lit(""))))).alias("definitions"),
    )


def response_context(spark, sf_dir, responses: DataFrame) -> DataFrame:
    """Model responses with the context of their page (title, url, course and module names)."""
    pages, modules, courses = stored_tables(spark, sf_dir)
    as_content = responses.select("page_id", "course_id").distinct().select(
        "page_id", "course_id", F.lit(None).cast("string").alias("url"), F.lit("").alias("markdown"))
    ctx = structure.enrich_context(as_content, pages, modules, courses).drop("markdown", "ok")
    return responses.join(ctx, ["course_id", "page_id"], "left")


def parsed_responses(spark, sf_dir, responses: DataFrame | None = None) -> DataFrame:
    responses = tables(spark, sf_dir)["llm_responses"] if responses is None else responses
    return structure.parse_structured(structure.extract_llm_json(response_context(spark, sf_dir, responses)))


@register("enrich_context")
def q_enrich_context(spark, sf_dir):
    return enriched(spark, sf_dir)


@register("build_llm_requests")
def q_build_llm_requests(spark, sf_dir):
    e = enriched(spark, sf_dir).filter("ok")
    every = structure.build_llm_requests(e, ("classify", "structure", "summarize"))
    return every.select("page_id", "task", "part", "prompt")


@register("extract_llm_json")
def q_extract_llm_json(spark, sf_dir):
    return structure.extract_llm_json(tables(spark, sf_dir)["llm_responses"]).select("page_id", "json_text")


@register("parse_structured")
def q_parse_structured(spark, sf_dir):
    return record_view(parsed_responses(spark, sf_dir))


@register("parse_classification")
def q_parse_classification(spark, sf_dir):
    ex = structure.extract_llm_json(tables(spark, sf_dir)["llm_responses"])
    return structure.parse_classification(ex).select("page_id", "cls_content_type", "cls_confidence", "cls_reasoning")


@register("structure_content")
def q_structure_content(spark, sf_dir):
    return record_view(structure.structure_content(enriched(spark, sf_dir)))


@register("summarize")
def q_summarize(spark, sf_dir):
    return structure.summarize(tables(spark, sf_dir)["content"]).select("page_id", "summary")


@register("classify_content")
def q_classify_content(spark, sf_dir):
    every = tables(spark, sf_dir)["content"].withColumn("title", F.lit(None).cast("string"))
    return structure.classify_content(every).select(
        "page_id", "cls_content_type", "cls_confidence", "cls_reasoning")


@register("resolve_ambiguous")
def q_resolve_ambiguous(spark, sf_dir):
    cls = structure.classify_content(enriched(spark, sf_dir))
    return structure.resolve_ambiguous(discovered(spark, sf_dir), cls).select(
        "course_id", "page_id", "content_type", "type_source")


@register("current_structured")
def q_current_structured(spark, sf_dir):
    versions = tables(spark, sf_dir)["structured_versions"]
    cur = structure.current_structured(cut_lineage(parsed_responses(spark, sf_dir, versions)))
    s = F.col("structured")
    return cur.select("page_id", "course_id", F.col("pos").cast("bigint").alias("pos"), s["title"].alias("title"),
                      s["content_type"].alias("content_type"), s["summary"].alias("summary"))


@register("processing_summary")
def q_processing_summary(spark, sf_dir):
    e = enriched(spark, sf_dir).select("page_id", "course_id", F.col("ok").alias("has_text"))
    p = parsed_responses(spark, sf_dir).select("course_id", "page_id", F.col("ok").alias("parsed"))
    results = e.join(p, ["course_id", "page_id"], "left").select(
        "course_id", "page_id", (F.col("has_text") & F.coalesce("parsed", F.lit(False))).alias("ok"))
    return state.processing_summary(results)


# ---------------------------------------------------------------- 2.4 / 2.5 / 2.6 / 2.8 documents
from sitelore.operators import documents as docs  # noqa: E402


def doc_inputs(spark, sf_dir):
    """Stage tables of the export: courses, numbered modules, module pages with content, and the
    current structured record per page (course taken from the page). Each is written once to the
    shared checkpoint folder because every document reads it."""
    t = tables(spark, sf_dir)
    pages0, modules, courses = stored_tables(spark, sf_dir)
    pages = stage(spark, sf_dir, "stored_pages", lambda: pages0)
    numbered = stage(spark, sf_dir, "numbered_modules", lambda: docs.number_modules(modules))
    # modules are joined to the bare pages, so that no text is dealt out again by module
    mpc = stage(spark, sf_dir, "module_pages",
                lambda: docs.page_content(docs.module_pages(numbered, pages), t["scraped"]))
    versions = stage(spark, sf_dir, "parsed_versions",
                     lambda: parsed_responses(spark, sf_dir, t["structured_versions"]))
    structured = stage(spark, sf_dir, "current_structured", lambda: structure.current_structured(versions).join(
        pages.select("course_id", "page_id"), ["course_id", "page_id"]))
    return courses.select("course_id", "name", "url"), numbered, mpc, structured


@register("number_modules")
def q_number_modules(spark, sf_dir):
    _, modules, _ = hierarchy_tables(spark, sf_dir)
    return docs.number_modules(modules).select("course_id", "module_id", "order_index", "idx", "prefix")


@register("page_content")
def q_page_content(spark, sf_dir):
    pages, _, _ = stored_tables(spark, sf_dir)
    pc = docs.page_content(pages, tables(spark, sf_dir)["scraped"])
    return pc.select("course_id", "page_id", "scraped", F.coalesce("markdown", F.lit("N/A")).alias("markdown"),
                     "retrieved_at")


@register("top_summaries")
def q_top_summaries(spark, sf_dir):
    _, _, _, structured = doc_inputs(spark, sf_dir)
    top = docs.top_summaries(structured)
    return top.select("course_id", "page_id", F.col("rank").cast("bigint").alias("rank"),
                      F.col("structured.summary").alias("summary"))


def module_struct(spark, sf_dir):
    _, numbered, mpc, structured = doc_inputs(spark, sf_dir)
    return mpc.join(structured.select("course_id", "page_id", "structured"), ["course_id", "page_id"])


@register("module_concepts")
def q_module_concepts(spark, sf_dir):
    return docs.module_concepts(module_struct(spark, sf_dir)).select("course_id", "module_id", "value", "rank")


@register("module_quiz_topics")
def q_module_quiz_topics(spark, sf_dir):
    return docs.module_concepts(module_struct(spark, sf_dir), "quiz_topics").select(
        "course_id", "module_id", "value", "rank")


@register("module_collections")
def q_module_collections(spark, sf_dir):
    return docs.module_collections(module_struct(spark, sf_dir))


@register("glossary")
def q_glossary(spark, sf_dir):
    _, _, _, structured = doc_inputs(spark, sf_dir)
    return docs.glossary(structured)


@register("doc_course_overview")
def q_doc_course_overview(spark, sf_dir):
    courses, numbered, mpc, structured = doc_inputs(spark, sf_dir)
    return docs.doc_course_overview(courses, numbered, mpc, structured)


@register("doc_source_layer")
def q_doc_source_layer(spark, sf_dir):
    courses, numbered, mpc, _ = doc_inputs(spark, sf_dir)
    return docs.doc_source_layer(courses, numbered, mpc)


@register("doc_knowledge_layer")
def q_doc_knowledge_layer(spark, sf_dir):
    courses, numbered, mpc, structured = doc_inputs(spark, sf_dir)
    return docs.doc_knowledge_layer(courses, numbered, mpc, structured)


@register("doc_quiz_bank")
def q_doc_quiz_bank(spark, sf_dir):
    courses, numbered, mpc, _ = doc_inputs(spark, sf_dir)
    return docs.doc_quiz_bank(courses, numbered, mpc)


@register("doc_assignments")
def q_doc_assignments(spark, sf_dir):
    courses, numbered, mpc, _ = doc_inputs(spark, sf_dir)
    return docs.doc_assignments(courses, numbered, mpc)


@register("doc_glossary")
def q_doc_glossary(spark, sf_dir):
    courses, _, _, structured = doc_inputs(spark, sf_dir)
    return docs.doc_glossary(courses, structured)


@register("doc_sources")
def q_doc_sources(spark, sf_dir):
    courses, numbered, mpc, _ = doc_inputs(spark, sf_dir)
    return docs.doc_sources(courses, numbered, mpc)


def all_documents(spark, sf_dir) -> DataFrame:
    courses, numbered, mpc, structured = doc_inputs(spark, sf_dir)
    parts = [docs.doc_course_overview(courses, numbered, mpc, structured),
             docs.doc_source_layer(courses, numbered, mpc),
             docs.doc_knowledge_layer(courses, numbered, mpc, structured),
             docs.doc_quiz_bank(courses, numbered, mpc), docs.doc_assignments(courses, numbered, mpc),
             docs.doc_glossary(courses, structured), docs.doc_sources(courses, numbered, mpc)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("render_documents")
def q_render_documents(spark, sf_dir):
    return docs.render_documents(all_documents(spark, sf_dir))


@register("export_manifest")
def q_export_manifest(spark, sf_dir):
    courses, numbered, _, _ = doc_inputs(spark, sf_dir)
    return docs.export_manifest(courses, numbered)


@register("export_file_type")
def q_export_file_type(spark, sf_dir):
    courses, numbered, _, _ = doc_inputs(spark, sf_dir)
    names = docs.export_manifest(courses, numbered).select("course_id", "filename")
    return names.select("course_id", "filename", rules.export_file_type(F.col("filename")).alias("file_type"))


# ---------------------------------------------------------------- 2.1 sinks and 2.9 streaming
import uuid  # noqa: E402

from sitelore.session import scratch_path  # noqa: E402
from sitelore.sources import files  # noqa: E402
from sitelore.streaming import jobs as streams  # noqa: E402


def _fresh(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _written_raw(spark, sf_dir) -> str:
    """Raw pages written in two goes, a site's pages in both."""
    c = fingerprinted(spark, sf_dir)
    path = _fresh(spark, "raw")
    files.write_raw(c.filter(F.col("page_id") % 3 == 0), path)
    files.write_raw(c.filter(F.col("page_id") % 3 != 0), path)
    return path


@register("write_raw")
def q_write_raw(spark, sf_dir):
    rows = spark.read.schema("course_id string, page_id bigint, file_key string, markdown string").json(
        _written_raw(spark, sf_dir))
    return rows.select("course_id", "page_id", "file_key", F.sha2(F.coalesce("markdown", F.lit("")), 256).alias("text_sha256"))


@register("read_raw")
def q_read_raw(spark, sf_dir):
    r = files.read_raw(spark, _written_raw(spark, sf_dir))
    return r.select("course_id", "page_id", "filename", "size_bytes", F.col("metadata")["url"].alias("url"),
                    F.col("metadata")["content_hash"].alias("content_hash"))


@register("write_processed")
def q_write_processed(spark, sf_dir):
    _, _, _, structured = doc_inputs(spark, sf_dir)
    path = _fresh(spark, "processed")
    files.write_processed(structured, path)
    back = files.read_processed(spark, path, structure.STRUCTURED_SCHEMA)
    return back.select("course_id", "page_id", F.col("structured.title").alias("title"),
                       F.col("structured.summary").alias("summary"))


def _written_exports(spark, sf_dir) -> str:
    path = _fresh(spark, "exports")
    files.write_exports(docs.render_documents(all_documents(spark, sf_dir)), path)
    return path


@register("write_exports")
def q_write_exports(spark, sf_dir):
    lines = files.read_exports(spark, _written_exports(spark, sf_dir))
    return lines.groupBy("course_id", "filename").agg(F.count(F.lit(1)).alias("n_lines"))


@register("list_exports")
def q_list_exports(spark, sf_dir):
    return files.list_exports(spark, _written_exports(spark, sf_dir))


def _stream_input(spark, df: DataFrame, name: str, parts: list) -> str:
    """Write ``df`` as several sets of files (one per filter in ``parts``, in order) for a stream to pick up."""
    path = _fresh(spark, f"stream-in/{name}")
    for cond in parts:
        df.filter(cond).write.mode("append").parquet(path)
    return path


CONTENT_SCHEMA = "page_id bigint, course_id string, url string, markdown string, retrieved_at timestamp_ntz"
LINKS_SCHEMA = "course_id string, ord bigint, url string, title string"
EVENTS_SCHEMA = "event_id bigint, job_id bigint, course_id string, ts timestamp_ntz, event string"


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    content = tables(spark, sf_dir)["content"]
    src = _stream_input(spark, content, "content", [F.col("page_id") % 4 == k for k in range(4)])
    sink, ckpt = _fresh(spark, "stream-out/ingest"), _fresh(spark, "stream-ckpt/ingest")
    streams.stream_ingest(spark, src, CONTENT_SCHEMA, sink, ckpt).awaitTermination()
    return spark.read.parquet(sink).select("url", "content_hash")


@register("stream_ingest_known")
def q_stream_ingest_known(spark, sf_dir):
    """Rows with even ids are stored before the stream starts; the others arrive."""
    content = tables(spark, sf_dir)["content"]
    known, new = known_and_new(spark, sf_dir)
    src = _stream_input(spark, content.filter("page_id % 2 <> 0"), "content", [F.col("page_id") % 4 == k for k in (3, 1)])
    sink, ckpt = _fresh(spark, "stream-out/ingest"), _fresh(spark, "stream-ckpt/ingest")
    streams.stream_ingest(spark, src, CONTENT_SCHEMA, sink, ckpt, stored=known).awaitTermination()
    return spark.read.parquet(sink).select("url", "content_hash")


@register("stream_discover")
def q_stream_discover(spark, sf_dir):
    t = tables(spark, sf_dir)
    parts = [F.col("ord") % 4 == k for k in (2, 0, 3, 1)]  # positions arrive out of order
    src = _stream_input(spark, t["links"], "links", parts)
    sink, ckpt = _fresh(spark, "stream-out/discover"), _fresh(spark, "stream-ckpt/discover")
    streams.stream_discover(spark, src, LINKS_SCHEMA, sink, ckpt).awaitTermination()
    return streams.discovered_from_stream(spark, sink, t["courses"])


@register("stream_progress")
def q_stream_progress(spark, sf_dir):
    ev = tables(spark, sf_dir)["job_events"]
    src = _stream_input(spark, ev, "events", [F.col("event_id") % 4 == k for k in range(4)])
    sink, ckpt = _fresh(spark, "stream-out/progress"), _fresh(spark, "stream-ckpt/progress")
    streams.stream_progress(spark, src, EVENTS_SCHEMA, sink, ckpt).awaitTermination()
    return streams.read_progress(spark, sink)


@register("humanize_segment")
def q_humanize_segment(spark, sf_dir):
    pages = discovered(spark, sf_dir)
    segs = pages.select("course_id", "page_id", F.explode(urls.path_segments(F.col("url"))).alias("segment")).distinct()
    return segs.select("course_id", "page_id", "segment", urls.humanize_segment(F.col("segment")).alias("module_title"))
