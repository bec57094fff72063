"""Export documents as line tables, for every site at once.

Every document is a set of rows ``(course_id, filename, sec, item, ln, line)`` ordered by
``(sec, item, ln)``: ``sec`` is the section (module number × 100 + part for site-level files),
``item`` the page (or -1 for a section heading, ``TAIL`` for its closing lines) and ``ln``
the line inside that item. No step gathers a whole document: ``render_documents`` joins
lines per ``(file, sec, item)`` block, which is at most one page's text, and
``write_exports`` range-partitions blocks so a large file is written by many tasks in order.

Inputs (all flat DataFrames):
* ``courses``: ``course_id, name, url``
* ``modules``: ``course_id, module_id, module_title, order_index``
* ``pages`` (stored): ``course_id, page_id, module_id, url, title, content_type``
* ``scraped``: ``course_id, page_id, markdown, retrieved_at`` (several versions allowed)
* ``structured``: ``page_id, course_id, structured, pos`` (current record per page)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.functions import rules
from sitelore.operators.ordering import prefix_over

# ---------------------------------------------------------------- fixed values
OVERVIEW_FILE = "course-overview.md"
QUIZ_FILE = "quiz-bank.md"
ASSIGNMENTS_FILE = "assignments.md"
GLOSSARY_FILE = "glossary.md"
SOURCES_FILE = "sources.md"
NO_STRUCTURED = "*No AI-structured content available for this module.*"
NO_QUIZ = "*No quiz content extracted.*"
NO_ASSIGNMENTS = "*No assignment content extracted.*"
NO_DEFINITIONS = "*No definitions extracted from course content.*"
SOURCES_INTRO = "All URLs referenced in this course extraction:"
TOP_SUMMARIES = 5
# ---------------------------------------------------------------- end of fixed values

TAIL = 1 << 62
LINE_COLS = ["course_id", "filename", "sec", "item", "ln", "line"]


def _lines(df: DataFrame, filename: Column, sec: Column, item: Column, lines: Sequence[Column]) -> DataFrame:
    """Emit ``lines`` (one per element, in order) for every row of ``df``."""
    arr = F.array(*lines)
    return df.select("course_id", filename.alias("filename"), sec.cast("bigint").alias("sec"),
                     item.cast("bigint").alias("item"), F.posexplode(arr).alias("ln", "line")).select(
        "course_id", "filename", "sec", "item", F.col("ln").cast("bigint").alias("ln"), "line")


def _lit_lines(*texts: str) -> list[Column]:
    return [F.lit(t) for t in texts]


def _or(a: Column, default: str) -> Column:
    """Python ``a or default`` for strings."""
    return F.coalesce(F.nullif(a, F.lit("")), F.lit(default))


# ---------------------------------------------------------------- stage tables
def number_modules(modules: DataFrame) -> DataFrame:
    """1-based export index by ``order_index`` and the ``module-%02d`` file prefix."""
    ranked = prefix_over(modules, ["course_id"], ["order_index", "module_id"], "idx")
    return ranked.withColumn("idx", F.col("idx") + 1).withColumn(
        "prefix", F.format_string("module-%02d", F.col("idx")))


def page_content(pages: DataFrame, scraped: DataFrame) -> DataFrame:
    """Pages ⟕ their latest scraped content (last ``retrieved_at`` wins), per site and page id. The largest
    (time, text) itself is the latest, so a text goes through the aggregate once."""
    latest = scraped.groupBy("course_id", "page_id").agg(F.max(F.struct("retrieved_at", "markdown")).alias("_s"))
    return pages.join(latest.select("course_id", "page_id", F.col("_s.markdown").alias("markdown"),
                                    F.col("_s.retrieved_at").alias("retrieved_at"), F.lit(True).alias("scraped")),
                      ["course_id", "page_id"], "left").withColumn("scraped", F.coalesce("scraped", F.lit(False)))


def module_pages(numbered: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each numbered module (stored assignment), with module number and title."""
    return pages.filter(F.col("module_id").isNotNull()).join(
        numbered.select("course_id", "module_id", "module_title", "idx", "prefix"), ["course_id", "module_id"])


def top_summaries(structured: DataFrame, k: int = TOP_SUMMARIES) -> DataFrame:
    """First ``k`` non-empty summaries per site by position (a top-k: the limit is the feature)."""
    from pyspark.sql import Window
    s = structured.filter(F.coalesce(F.col("structured.summary"), F.lit("")) != "")
    w = Window.partitionBy("course_id").orderBy("pos", "page_id")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def module_concepts(mstruct: DataFrame, field: str = "key_concepts") -> DataFrame:
    """Distinct values of a list field per module with their code-point rank (0-based)."""
    vals = mstruct.select("course_id", "module_id", F.explode(f"structured.{field}").alias("value")).distinct()
    return prefix_over(vals, ["course_id", "module_id"], ["value"], "rank")


def module_collections(mstruct: DataFrame) -> DataFrame:
    """Per module, in page order, every objective, complete definition, formula and summary
    (duplicates kept): ``course_id, module_id, kind, page_id, pos, value``."""
    s = F.col("structured")
    base = mstruct.select("course_id", "module_id", "page_id", "structured")
    obj = base.select("course_id", "module_id", "page_id", F.lit("objective").alias("kind"),
                      F.posexplode(s["learning_objectives"]).alias("pos", "value"))
    defs = base.select("course_id", "module_id", "page_id", F.posexplode(s["definitions"]).alias("pos", "d")).filter(
        (F.coalesce(F.col("d.term"), F.lit("")) != "") & (F.coalesce(F.col("d.definition"), F.lit("")) != "")
    ).select("course_id", "module_id", "page_id", F.lit("definition").alias("kind"), "pos",
             F.concat(F.lit("- **"), F.col("d.term"), F.lit("**: "), F.col("d.definition")).alias("value"))
    forms = base.select("course_id", "module_id", "page_id", F.lit("formula").alias("kind"),
                        F.posexplode(s["important_formulas"]).alias("pos", "value"))
    sums = base.filter(F.coalesce(s["summary"], F.lit("")) != "").select(
        "course_id", "module_id", "page_id", F.lit("summary").alias("kind"), F.lit(0).alias("pos"),
        s["summary"].alias("value"))
    return obj.unionByName(defs).unionByName(forms).unionByName(sums).withColumn("pos", F.col("pos").cast("bigint"))


def glossary(structured: DataFrame) -> DataFrame:
    """Course-wide definitions: first (by position, then list order) per lower-cased term, empty
    terms dropped, empty definitions kept. One partial aggregate per (site, lower(term))."""
    d = structured.select("course_id", "page_id", "pos", F.posexplode("structured.definitions").alias("dpos", "d"))
    d = d.select("course_id", F.coalesce(F.col("d.term"), F.lit("")).alias("term"),
                 F.coalesce(F.col("d.definition"), F.lit("")).alias("definition"),
                 F.struct("pos", "page_id", "dpos").alias("_o")).filter(F.col("term") != "")
    first = d.groupBy("course_id", F.lower("term").alias("term_key")).agg(
        F.min_by(F.struct("term", "definition"), F.col("_o")).alias("_f"))
    return first.select("course_id", "term_key", F.col("_f.term").alias("term"), F.col("_f.definition").alias("definition"))


def _with_struct(mpages: DataFrame, structured: DataFrame) -> DataFrame:
    return mpages.join(structured.select("course_id", "page_id", "structured"), ["course_id", "page_id"])


# ---------------------------------------------------------------- documents
def doc_course_overview(courses, numbered, mpages, structured) -> DataFrame:
    fname = F.lit(OVERVIEW_FILE)
    n_mod = numbered.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_modules"))
    c = courses.join(n_mod, "course_id", "left").withColumn("n_modules", F.coalesce("n_modules", F.lit(0)))
    header = _lines(c, fname, F.lit(0), F.lit(-1), [
        F.concat(F.lit("# "), F.col("name")), F.lit(""), F.concat(F.lit("Course URL: "), F.col("url")),
        F.concat(F.lit("Total Modules: "), F.col("n_modules").cast("string")), F.lit(""), F.lit("---"), F.lit(""),
        F.lit("## Course Structure"), F.lit("")])
    sec = F.col("idx") * 100
    mod_head = _lines(numbered, fname, sec, F.lit(-1), [
        F.concat(F.lit("### Module "), F.col("idx").cast("string"), F.lit(": "), F.col("module_title")), F.lit("")])
    badge = F.when(F.col("content_type") != "other", F.concat(F.lit("["), F.col("content_type"), F.lit("]"))).otherwise(F.lit(""))
    page_lines = _lines(mpages, fname, sec, F.col("page_id"), [
        F.concat(F.lit("- "), _or(F.col("title"), "Untitled"), F.lit(" "), badge)])
    mod_tail = _lines(numbered, fname, sec, F.lit(TAIL), [F.lit("")])
    top = top_summaries(structured)
    sum_sec = F.lit(TAIL)
    sum_head = _lines(top.filter(F.col("rank") == 1), fname, sum_sec, F.lit(-1), _lit_lines("## Course Summary", ""))
    sum_lines = _lines(top, fname, sum_sec, F.col("rank"), [
        F.concat(F.lit("**"), F.col("structured.title"), F.lit("**: "), F.col("structured.summary")), F.lit("")])
    return header.unionByName(mod_head).unionByName(page_lines).unionByName(mod_tail).unionByName(
        sum_head).unionByName(sum_lines)


def _module_header(numbered, courses, mpages, suffix: str) -> tuple[DataFrame, Column]:
    fname = F.concat(F.col("prefix"), F.lit(suffix))
    nc = numbered.join(courses.select("course_id", F.col("name").alias("course_name")), "course_id", "left")
    head = _lines(nc, fname, F.lit(0), F.lit(-1), [
        F.concat(F.lit("# "), F.col("module_title")), F.lit(""),
        F.concat(F.lit("Course: "), F.coalesce(F.col("course_name"), F.lit(""))), F.lit(""), F.lit("Source URLs:")])
    urls = _lines(mpages, fname, F.lit(1), F.col("page_id"), [F.concat(F.lit("- "), F.col("url"))])
    sep = _lines(numbered, fname, F.lit(2), F.lit(-1), _lit_lines("", "---", ""))
    return head.unionByName(urls).unionByName(sep), fname


def doc_source_layer(courses, numbered, mpages_content) -> DataFrame:
    head, fname = _module_header(numbered, courses, mpages_content, "-source.md")
    sc = mpages_content.filter("scraped")
    md = F.coalesce(F.col("markdown"), F.lit(""))
    block_with = _lines(sc.filter(md != ""), fname, F.lit(3), F.col("page_id"), [
        F.concat(F.lit("## "), _or(F.col("title"), "Untitled")), F.lit(""),
        F.concat(F.lit("*Source: "), F.col("url"), F.lit("*")),
        F.concat(F.lit("*Type: "), F.col("content_type"), F.lit("*")), F.lit(""), md, F.lit(""), F.lit("---"), F.lit("")])
    block_without = _lines(sc.filter(md == ""), fname, F.lit(3), F.col("page_id"), [
        F.concat(F.lit("## "), _or(F.col("title"), "Untitled")), F.lit(""),
        F.concat(F.lit("*Source: "), F.col("url"), F.lit("*")),
        F.concat(F.lit("*Type: "), F.col("content_type"), F.lit("*")), F.lit(""), F.lit(""), F.lit("---"), F.lit("")])
    return head.unionByName(block_with).unionByName(block_without)


def _section(entries: DataFrame, sec: int, heading: Sequence[str], tail: Sequence[str] = ("",)) -> DataFrame:
    """Heading and tail lines for every file that has at least one entry line in ``sec``."""
    files = entries.select("course_id", "filename").distinct()
    head = _lines(files, F.col("filename"), F.lit(sec), F.lit(-1), _lit_lines(*heading))
    parts = [head, entries]
    if tail:
        parts.append(_lines(files, F.col("filename"), F.lit(sec), F.lit(TAIL), _lit_lines(*tail)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def doc_knowledge_layer(courses, numbered, mpages, structured) -> DataFrame:
    """Knowledge file per module: sections are emitted only when they have content."""
    head, fname = _module_header(numbered, courses, mpages, "-knowledge.md")
    ms = _with_struct(mpages, structured)
    s = F.col("structured")
    has = ms.select("course_id", "module_id").distinct()
    empty_mods = numbered.join(has, ["course_id", "module_id"], "left_anti")
    none_msg = _lines(empty_mods, fname, F.lit(3), F.lit(-1), [F.lit(NO_STRUCTURED)])
    with_sum = ms.filter(F.coalesce(s["summary"], F.lit("")) != "")
    # 3 overview: heading always (module has structured content), then each summary
    overview = _lines(numbered.join(has, ["course_id", "module_id"], "left_semi"), fname, F.lit(3), F.lit(-1),
                      _lit_lines("## Overview", "")).unionByName(
        _lines(with_sum, fname, F.lit(3), F.col("page_id"), [s["summary"], F.lit("")]))
    coll = module_collections(ms).join(numbered.select("course_id", "module_id", "prefix"), ["course_id", "module_id"])
    cfname = F.concat(F.col("prefix"), F.lit("-knowledge.md"))

    def kind_lines(kind: str, sec: int, fmt) -> DataFrame:
        rows = coll.filter(F.col("kind") == kind)
        return rows.select("course_id", cfname.alias("filename"), F.lit(sec).cast("bigint").alias("sec"),
                           F.col("page_id").cast("bigint").alias("item"), F.col("pos").alias("ln"),
                           fmt(F.col("value")).alias("line"))

    objectives = _section(kind_lines("objective", 4, lambda v: F.concat(F.lit("- "), v)), 4,
                          ("## Learning Objectives", ""))
    per_page = _lines(ms, fname, F.lit(5), F.col("page_id"), [
        F.concat(F.lit("## "), s["title"]), F.lit("")]).unionByName(
        _lines(with_sum, fname, F.lit(5), F.col("page_id"), [s["summary"], F.lit("")]).withColumn(
            "ln", F.col("ln") + 2))
    concepts = module_concepts(ms).join(numbered.select("course_id", "module_id", "prefix"), ["course_id", "module_id"])
    concept_lines = concepts.select("course_id", cfname.alias("filename"), F.lit(6).cast("bigint").alias("sec"),
                                    F.col("rank").alias("item"), F.lit(0).cast("bigint").alias("ln"),
                                    F.concat(F.lit("- **"), F.col("value"), F.lit("**")).alias("line"))
    key_concepts = _section(concept_lines, 6, ("## Key Concepts", ""))
    # definitions heading appears when any definition exists, even if none is complete
    any_def = ms.filter(F.size(s["definitions"]) > 0).select("course_id", "module_id").distinct().join(
        numbered.select("course_id", "module_id", "prefix"), ["course_id", "module_id"])
    def_files = any_def.select("course_id", cfname.alias("filename"))
    definitions = _lines(def_files, F.col("filename"), F.lit(7), F.lit(-1), _lit_lines("## Definitions", "")).unionByName(
        kind_lines("definition", 7, lambda v: v)).unionByName(
        _lines(def_files, F.col("filename"), F.lit(7), F.lit(TAIL), [F.lit("")]))
    formulas = _section(kind_lines("formula", 8, lambda v: F.concat(F.lit("- "), v)), 8, ("## Important Formulas", ""))
    quiz = module_concepts(ms, "quiz_topics").join(numbered.select("course_id", "module_id", "prefix"),
                                                     ["course_id", "module_id"])
    quiz_lines = quiz.select("course_id", cfname.alias("filename"), F.lit(9).cast("bigint").alias("sec"),
                             F.col("rank").alias("item"), F.lit(0).cast("bigint").alias("ln"),
                             F.concat(F.lit("- "), F.col("value")).alias("line"))
    quiz_topics = _section(quiz_lines, 9, ("## Quiz Topics", ""))
    mod_with = numbered.join(has, ["course_id", "module_id"], "left_semi")
    summary = _lines(mod_with, fname, F.lit(10), F.lit(-1), _lit_lines("## Module Summary", "")).unionByName(
        _lines(with_sum, fname, F.lit(10), F.col("page_id"), [
            F.concat(F.lit("- **"), s["title"], F.lit("**: "), s["summary"])])).unionByName(
        _lines(mod_with, fname, F.lit(10), F.lit(TAIL), [F.lit("")]))
    out = head.unionByName(none_msg)
    for part in (overview, objectives, per_page, key_concepts, definitions, formulas, quiz_topics, summary):
        out = out.unionByName(part)
    return out


def _typed_bank(courses, numbered, mpc, types: Sequence[str], filename: str, title: str,
                default_title: str, empty_msg: str) -> DataFrame:
    fname = F.lit(filename)
    head = _lines(courses, fname, F.lit(0), F.lit(-1), [F.lit(title), F.lit(""), F.lit("---"), F.lit("")])
    typed = mpc.filter(F.col("content_type").isin(list(types)))
    mods = typed.select("course_id", "module_id", "idx", "module_title").distinct()
    sec = F.col("idx") * 100
    mod_head = _lines(mods, fname, sec, F.lit(-1), [F.concat(F.lit("## "), F.col("module_title")), F.lit("")])
    md = F.coalesce(F.col("markdown"), F.lit(""))
    pages = _lines(typed.filter(F.col("scraped") & (md != "")), fname, sec, F.col("page_id"), [
        F.concat(F.lit("### "), _or(F.col("title"), default_title)),
        F.concat(F.lit("*Source: "), F.col("url"), F.lit("*")), F.lit(""), md, F.lit(""), F.lit("---"), F.lit("")])
    empty = _lines(courses.join(mods, "course_id", "left_anti"), fname, F.lit(TAIL), F.lit(-1), [F.lit(empty_msg)])
    return head.unionByName(mod_head).unionByName(pages).unionByName(empty)


def doc_quiz_bank(courses, numbered, mpc) -> DataFrame:
    return _typed_bank(courses, numbered, mpc, ["quiz"], QUIZ_FILE, "# Quiz Bank", "Quiz", NO_QUIZ)


def doc_assignments(courses, numbered, mpc) -> DataFrame:
    return _typed_bank(courses, numbered, mpc, ["assignment", "project"], ASSIGNMENTS_FILE, "# Assignments",
                       "Assignment", NO_ASSIGNMENTS)


def doc_glossary(courses, structured) -> DataFrame:
    fname = F.lit(GLOSSARY_FILE)
    head = _lines(courses, fname, F.lit(0), F.lit(-1), _lit_lines("# Glossary", "", "---", ""))
    any_def = structured.filter(F.size("structured.definitions") > 0).select("course_id").distinct()
    none = _lines(courses.join(any_def, "course_id", "left_anti"), fname, F.lit(1), F.lit(-1), [F.lit(NO_DEFINITIONS)])
    g = prefix_over(glossary(structured), ["course_id"], ["term_key"], "rank")
    entries = _lines(g, fname, F.lit(1), F.col("rank"), [
        F.concat(F.lit("**"), F.col("term"), F.lit("**")), F.concat(F.lit(": "), F.col("definition")), F.lit("")])
    return head.unionByName(none).unionByName(entries)


def iso_utc(ts: Column) -> Column:
    """Timestamp rendered like Python ``datetime.isoformat()`` of an aware UTC time."""
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")), F.lit("+00:00"))


def doc_sources(courses, numbered, mpc) -> DataFrame:
    fname = F.lit(SOURCES_FILE)
    head = _lines(courses, fname, F.lit(0), F.lit(-1), _lit_lines("# Sources", "", SOURCES_INTRO, "", "---", ""))
    sec = F.col("idx") * 100
    mod_head = _lines(numbered, fname, sec, F.lit(-1), [F.concat(F.lit("## "), F.col("module_title")), F.lit("")])
    retrieved = F.when(F.col("scraped"), iso_utc(F.col("retrieved_at"))).otherwise(F.lit("N/A"))
    label = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"))
    pages = _lines(mpc, fname, sec, F.col("page_id"), [F.concat(
        F.lit("- ["), label, F.lit("]("), F.col("url"), F.lit(") — *"), F.col("content_type"),
        F.lit("* — Retrieved: "), retrieved)])
    tail = _lines(numbered, fname, sec, F.lit(TAIL), [F.lit("")])
    return head.unionByName(mod_head).unionByName(pages).unionByName(tail)


def render_documents(lines: DataFrame) -> DataFrame:
    """Text per ``(file, sec, item)`` block, lines joined with '\\n' in ``ln`` order. A block is
    one page or one heading, so no aggregate ever holds a whole document."""
    return lines.groupBy("course_id", "filename", "sec", "item").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
        .alias("text"))


def export_manifest(courses: DataFrame, numbered: DataFrame) -> DataFrame:
    """Ordered file list per site and ``files_generated`` = 5 + 2 × modules."""
    tail_files = [QUIZ_FILE, ASSIGNMENTS_FILE, GLOSSARY_FILE, SOURCES_FILE]
    fixed = courses.select("course_id", F.posexplode(F.array(*[F.lit(f) for f in [OVERVIEW_FILE] + tail_files]))
                           .alias("p", "filename")).select(
        "course_id", F.when(F.col("p") == 0, F.lit(0)).otherwise(F.lit(TAIL) + F.col("p")).cast("bigint").alias("seq"),
        "filename")
    per_mod = numbered.select("course_id", F.posexplode(F.array(
        F.concat(F.col("prefix"), F.lit("-source.md")), F.concat(F.col("prefix"), F.lit("-knowledge.md")))).alias(
        "p", "filename"), "idx").select("course_id", (F.col("idx") * 2 + F.col("p") - 1).cast("bigint").alias("seq"),
                                        "filename")
    files = fixed.unionByName(per_mod)
    n = numbered.groupBy("course_id").agg(F.count(F.lit(1)).alias("_n"))
    return files.join(n, "course_id", "left").select(
        "course_id", "seq", "filename", rules.export_file_type(F.col("filename")).alias("file_type"),
        (F.lit(5) + 2 * F.coalesce(F.col("_n"), F.lit(0))).cast("bigint").alias("files_generated"))
