"""Documents on a hand-built site, rendered and concatenated, against the expected text."""

import datetime as dt

from pyspark.sql import functions as F

from sitelore.operators import documents as docs
from sitelore.plans import catalog
from sitelore.sources.fixtures import tables

STRUCT = ("struct<title:string,course:string,module:string,content_type:string,learning_objectives:array<string>,"
          "key_concepts:array<string>,definitions:array<struct<term:string,definition:string>>,examples:array<string>,"
          "important_formulas:array<string>,prerequisites:array<string>,quiz_topics:array<string>,summary:string,"
          "source_url:string>")


def build(spark):
    courses = spark.createDataFrame([("c", "Algebra", "https://s.edu/")], "course_id string, name string, url string")
    modules = spark.createDataFrame([("c", "m1", "Week One", 0)], "course_id string, module_id string, module_title string, order_index bigint")
    pages = spark.createDataFrame([
        ("c", 1, "m1", "https://s.edu/w1/quiz", "Quiz 1", "quiz"),
        ("c", 2, "m1", "https://s.edu/w1/notes", "", "other")],
        "course_id string, page_id bigint, module_id string, url string, title string, content_type string")
    t = dt.datetime(2024, 1, 1, 0, 5)
    scraped = spark.createDataFrame([("c", 1, "Q text", t), ("c", 1, "old", dt.datetime(2023, 1, 1))],
                                    "course_id string, page_id bigint, markdown string, retrieved_at timestamp_ntz")
    rec = {"title": "Quiz One", "course": "Algebra", "module": "Week One", "content_type": "quiz",
           "learning_objectives": ["solve"], "key_concepts": ["b", "a", "b"],
           "definitions": [{"term": "Set", "definition": "a collection"}, {"term": "", "definition": "x"}],
           "examples": [], "important_formulas": [], "prerequisites": [], "quiz_topics": [], "summary": "Sum.",
           "source_url": "https://s.edu/w1/quiz"}
    structured = spark.createDataFrame([(1, "c", rec, 1)], f"page_id bigint, course_id string, structured {STRUCT}, pos bigint")
    numbered = docs.number_modules(modules)
    mpc = docs.module_pages(numbered, docs.page_content(pages, scraped))
    return courses, numbered, mpc, structured


def text_of(lines, filename):
    rows = lines.filter(F.col("filename") == filename).orderBy("sec", "item", "ln").select("line").collect()
    return "\n".join(r[0] for r in rows)


def test_quiz_bank_sources_glossary_overview(spark):
    courses, numbered, mpc, structured = build(spark)
    assert text_of(docs.doc_quiz_bank(courses, numbered, mpc), "quiz-bank.md") == \
        "# Quiz Bank\n\n---\n\n## Week One\n\n### Quiz 1\n*Source: https://s.edu/w1/quiz*\n\nQ text\n\n---\n"
    assert text_of(docs.doc_sources(courses, numbered, mpc), "sources.md") == (
        "# Sources\n\nAll URLs referenced in this course extraction:\n\n---\n\n## Week One\n\n"
        "- [Quiz 1](https://s.edu/w1/quiz) — *quiz* — Retrieved: 2024-01-01T00:05:00+00:00\n"
        "- [https://s.edu/w1/notes](https://s.edu/w1/notes) — *other* — Retrieved: N/A\n")
    assert text_of(docs.doc_glossary(courses, structured), "glossary.md") == \
        "# Glossary\n\n---\n\n**Set**\n: a collection\n"
    assert text_of(docs.doc_assignments(courses, numbered, mpc), "assignments.md") == \
        "# Assignments\n\n---\n\n*No assignment content extracted.*"
    assert text_of(docs.doc_course_overview(courses, numbered, mpc, structured), "course-overview.md") == (
        "# Algebra\n\nCourse URL: https://s.edu/\nTotal Modules: 1\n\n---\n\n## Course Structure\n\n"
        "### Module 1: Week One\n\n- Quiz 1 [quiz]\n- Untitled \n\n## Course Summary\n\n**Quiz One**: Sum.\n")


def test_knowledge_layer(spark):
    courses, numbered, mpc, structured = build(spark)
    got = text_of(docs.doc_knowledge_layer(courses, numbered, mpc, structured), "module-01-knowledge.md")
    assert got == (
        "# Week One\n\nCourse: Algebra\n\nSource URLs:\n- https://s.edu/w1/quiz\n- https://s.edu/w1/notes\n\n---\n\n"
        "## Overview\n\nSum.\n\n## Learning Objectives\n\n- solve\n\n## Quiz One\n\nSum.\n\n"
        "## Key Concepts\n\n- **a**\n- **b**\n\n## Definitions\n\n- **Set**: a collection\n\n"
        "## Module Summary\n\n- **Quiz One**: Sum.\n")


def test_render_blocks_concatenate_to_document(spark):
    courses, numbered, mpc, structured = build(spark)
    lines = docs.doc_source_layer(courses, numbered, mpc)
    blocks = docs.render_documents(lines).filter(F.col("filename") == "module-01-source.md").orderBy("sec", "item")
    assert "\n".join(r["text"] for r in blocks.collect()) == text_of(lines, "module-01-source.md")
    manifest = docs.export_manifest(courses, numbered).orderBy("seq").collect()
    assert [r["filename"] for r in manifest] == ["course-overview.md", "module-01-source.md", "module-01-knowledge.md",
                                                 "quiz-bank.md", "assignments.md", "glossary.md", "sources.md"]
    assert {r["files_generated"] for r in manifest} == {7}
    assert [r["file_type"] for r in manifest] == ["overview", "source", "knowledge", "quiz", "assignment",
                                                  "glossary", "source"]


def test_stored_pages_hold_every_document(spark):
    sf = "/root/testdata/sf0.001"
    held = [r.markdown for r in catalog.q_page_content(spark, sf).where("scraped").collect()]
    texts = [r.text for r in tables(spark, sf)["documents"].collect()]
    assert len(texts) == 200 and sum(any(t in m for m in held) for t in texts) == 200


def test_page_without_content_is_not_scraped(spark):
    pages = spark.createDataFrame([("c", 1), ("c", 2)], "course_id string, page_id bigint")
    scraped = spark.createDataFrame([("c", 1, "text", dt.datetime(2024, 1, 1))],
                                    "course_id string, page_id bigint, markdown string, retrieved_at timestamp_ntz")
    got = {r.page_id: (r.scraped, r.markdown) for r in docs.page_content(pages, scraped).collect()}
    assert got == {1: (True, "text"), 2: (False, None)}


def test_latest_content_carries_a_text_once(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2)], "course_id string, page_id bigint")
    scraped = spark.createDataFrame([("a", 1, "old", 1), ("a", 1, "x", 2), ("a", 1, "y", 2), ("a", 1, "no time", None), ("b", 2, "z", 1)],
                                    "course_id string, page_id bigint, markdown string, retrieved_at bigint")
    got = docs.page_content(pages, scraped)
    assert "max_by" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("a", 1, "y", 2, True), ("a", 2, None, None, False)]
