"""Model-output parsing: fences, embedded JSON, strict types and defaults."""

from pyspark.sql import functions as F

from sitelore.operators import content, structure
from sitelore.sources.fixtures import tables

CTX = "page_id bigint, response string, title string, course_name string, module_name string, url string"


def parse(spark, responses):
    rows = [(i, r, "Page", "Course", "Mod", "https://s/p") for i, r in enumerate(responses)]
    df = spark.createDataFrame(rows, CTX)
    return [r.asDict(recursive=True) for r in
            structure.parse_structured(structure.extract_llm_json(df)).orderBy("page_id").collect()]


def test_extract_json_variants(spark):
    texts = ['  {"a": 1} ', '```json\n{"a": 2}\n```', 'Here: {"a": 3} done', "no json", '{"a": } {"b": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id bigint, response string")
    got = [r[0] for r in structure.extract_llm_json(df).orderBy("page_id").select("json_text").collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": 3}', None, None]


def test_parse_defaults_and_failures(spark):
    out = parse(spark, [
        '{"summary": "s"}',
        '{"title": null}',
        '{"key_concepts": ["a", 1]}',
        '{"content_type": "bogus"}',
        '{"content_type": "quiz", "definitions": [{"term": "T", "definition": "D"}], "source_url": "x"}',
        '[1, 2]',
    ])
    assert out[0]["ok"] and out[0]["structured"]["title"] == "Page" and out[0]["structured"]["course"] == "Course"
    assert out[0]["structured"]["content_type"] == "other" and out[0]["structured"]["key_concepts"] == []
    assert [o["error"] for o in out[1:4]] == ["invalid title", "invalid key_concepts", "invalid content_type"]
    assert out[4]["ok"] and out[4]["structured"]["source_url"] == "https://s/p"
    assert out[4]["structured"]["definitions"] == [{"term": "T", "definition": "D"}]
    assert out[5]["error"] == "not a JSON object"


def test_classification_fallback(spark):
    df = spark.createDataFrame([(1, '{"content_type": "quiz", "confidence": "0.7"}'), (2, '{"content_type": "nope"}'),
                                (3, '{"reasoning": 5}'), (4, '{}')], "page_id bigint, json_text string")
    got = [(r[0], r[1]) for r in structure.parse_classification(df).orderBy("page_id").select(
        "cls_content_type", "cls_confidence").collect()]
    assert got == [("quiz", 0.7), ("other", 0.0), ("other", 0.0), ("other", 0.5)]


def test_extractive_provider(spark):
    md = "# T\nFirst one. Second! Third? Fourth.\n**Term**: meaning\n## Learning objectives\n- know x\n- do y\n$E=mc^2$"
    df = spark.createDataFrame([(1, md, "T", "C", "M", "u", "lecture", True)],
                               "page_id bigint, markdown string, title string, course_name string, module_name string, "
                               "url string, content_type string, ok boolean")
    s = structure.structure_content(df).first()["structured"].asDict(recursive=True)
    assert s["summary"] == "# T First one. Second! Third?"
    assert s["key_concepts"] == ["Term"]
    assert s["definitions"] == [{"term": "Term", "definition": "meaning"}]
    assert s["learning_objectives"] == ["know x", "do y"]
    assert s["important_formulas"] == ["E=mc^2"]


ENRICHED = ("course_id string, page_id bigint, markdown string, title string, course_name string, module_name string, "
            "url string, content_type string, ok boolean")


def test_provider_hook_runs_in_map_in_pandas(spark):
    df = spark.createDataFrame([("a", 1, "text", "T", "C", "M", "u", "lecture", True), ("b", 1, "", "T", "C", "M", "u", "quiz", False)],
                               ENRICHED)

    def provider(pdf):
        return ['```json\n{"summary": "from model", "content_type": "quiz"}\n```' for _ in range(len(pdf))]

    got = {r["course_id"]: r for r in structure.structure_content(df, provider=provider, partitions=2).collect()}
    s = got["a"]
    assert s["ok"] and s["structured"]["summary"] == "from model" and s["structured"]["content_type"] == "quiz"
    assert not got["b"]["ok"] and got["b"]["error"] == "empty content" and len(got) == 2


def test_requests_cover_whole_text_and_parts_merge(spark):
    text = "".join(f"word{i} " for i in range(3000))
    df = spark.createDataFrame([("a", 1, text, "T", "C", "M", "u", "lecture", True)], ENRICHED)
    prompts = [r["prompt"] for r in structure.build_llm_requests(df, "structure").orderBy("part").collect()]
    assert len(prompts) == 4 and "".join(p.split("\n\nContent:\n")[1].removesuffix("\n") for p in prompts) == text
    assert structure.build_llm_requests(df, "structure", limit=100).count() == 1

    def provider(pdf):
        return ['{"summary": "s%d", "key_concepts": ["k", "k%d"], "content_type": "quiz"}' % (p, p) for p in pdf["part"]]

    s = structure.structure_content(df, provider=provider).first()["structured"]
    assert s["summary"] == "s0 s1 s2 s3" and s["key_concepts"] == ["k", "k0", "k1", "k2", "k3"]


def test_sites_may_share_page_ids(spark):
    content = spark.createDataFrame([("a", 1, "text a", "ua"), ("b", 1, "text b", "ub")],
                                    "course_id string, page_id bigint, markdown string, url string")
    pages = spark.createDataFrame([("a", 1, "A", "pa", "quiz", "m"), ("b", 1, "B", "pb", "lab", "m")],
                                  "course_id string, page_id bigint, title string, url string, content_type string, module_id string")
    modules = spark.createDataFrame([("a", "m", "MA"), ("b", "m", "MB")], "course_id string, module_id string, module_title string")
    courses = spark.createDataFrame([("a", "CA"), ("b", "CB")], "course_id string, name string")
    got = structure.enrich_context(content, pages, modules, courses)
    assert sorted((r.course_id, r.title, r.module_name, r.url) for r in got.collect()) == [
        ("a", "A", "MA", "pa"), ("b", "B", "MB", "pb")]
    typed = structure.resolve_ambiguous(pages.withColumn("content_type", F.lit("other")),
                                        got.select("course_id", "page_id", F.col("title").alias("cls_content_type")))
    assert sorted((r.course_id, r.content_type) for r in typed.collect()) == [("a", "A"), ("b", "B")]


def test_providers_classify_and_summarize_whole_texts(spark):
    df = spark.createDataFrame([("a", 1, "x" * 7000, "T", "C", "M", "u", "other", True), ("a", 2, "", "T", "C", "M", "u", "other", False)],
                               ENRICHED)

    def typed(pdf):
        return ['{"content_type": "%s", "confidence": %s}' % (("quiz", 0.9) if p == 2 else ("lab", 0.3)) for p in pdf["part"]]

    got = {r["page_id"]: r["cls_content_type"] for r in structure.classify_content(df, provider=typed).collect()}
    assert got == {1: "quiz", 2: None}
    got = {r["page_id"]: r["summary"] for r in structure.summarize(
        df, provider=lambda pdf: [f" part {p} " for p in pdf["part"]]).collect()}
    assert got == {1: "part 0 part 1", 2: ""}


def test_content_holds_every_text(spark):
    t = tables(spark, "/root/testdata/sf0.001")
    got = {(r.page_id, r.markdown) for r in t["content"].collect()}
    assert len(got) == 200 and got == {(r.doc_id, r.text) for r in t["documents"].collect()}


def test_empty_markdown(spark):
    df = spark.createDataFrame([(1, "u", "", None), (2, "u", "One. Two.", None)],
                               "page_id bigint, url string, markdown string, title string")
    assert {r.page_id: r.summary for r in structure.summarize(df).collect()} == {1: "", 2: "One. Two."}
    assert {r.page_id: r.cls_content_type for r in structure.classify_content(df).collect()}[1] == "other"
    hashes = {r.page_id: r.content_hash for r in content.content_fingerprint(df).collect()}
    assert hashes[1] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" != hashes[2]


def test_records_follow_the_texts(spark):
    """The record queries read the documents' texts: more text, more distinct terms."""
    from sitelore.plans import catalog
    terms = [catalog.QUERIES["glossary"](spark, f"/root/testdata/{sf}").select("term").distinct().count()
             for sf in ("sf0.001", "sf0.01")]
    assert terms[1] > 2 * terms[0]


def _pages_to_ask(spark, n=12):
    return spark.createDataFrame([("a", i, f"text {i}", "T", "C", "M", "u", "lecture", True) for i in range(n)], ENRICHED)


def test_a_failing_row_leaves_its_batch_whole(spark):
    def provider(pdf):
        if any("text 7" in p for p in pdf["prompt"]):
            raise RuntimeError("no answer to seven")
        return ['{"summary": "ok"}'] * len(pdf)

    got = {r.page_id: r for r in structure.structure_content(_pages_to_ask(spark), provider=provider, partitions=1).collect()}
    assert [i for i, r in got.items() if not r.ok] == [7] and got[7].error == "RuntimeError: no answer to seven"
    short = structure.structure_content(_pages_to_ask(spark, 1), provider=lambda pdf: []).first()
    assert not short.ok and short.error == "ValueError: 0 responses to 1 requests"


def test_response_log_asks_only_what_is_unanswered(spark, tmp_path):
    calls = tmp_path / "calls"

    def provider_failing_on(bad):
        def provider(pdf):
            with open(calls, "a") as f:
                f.write("".join(f"{p.split()[-1]}\n" for p in pdf["prompt"]) if len(pdf) == 1 or not bad else "")
            if any(p.split()[-1] == bad for p in pdf["prompt"]):
                raise RuntimeError("later")
            return ['{"summary": "ok"}'] * len(pdf)
        return provider

    log, df = str(tmp_path / "log"), _pages_to_ask(spark)
    first = structure.structure_content(df, provider=provider_failing_on("7"), partitions=1, log=log).collect()
    assert sorted(r.page_id for r in first if not r.ok) == [7] and {r.error for r in first if not r.ok} == {"RuntimeError: later"}
    calls.write_text("")
    second = structure.structure_content(df, provider=provider_failing_on(None), log=log).collect()
    assert all(r.ok for r in second) and calls.read_text().split() == ["7"]
    calls.write_text("")
    third = structure.structure_content(df, provider=provider_failing_on(None), log=log).collect()
    assert len(third) == 12 and all(r.ok for r in third) and calls.read_text() == ""


def test_equal_prompts_are_asked_once(spark, tmp_path):
    rows = [(c, 1, "same", "T", "C", "M", "u", "lecture", True) for c in "abc"]
    seen = tmp_path / "seen"

    def provider(pdf):
        with open(seen, "a") as f:
            f.write("x" * len(pdf))
        return ['{"summary": "ok"}'] * len(pdf)

    got = structure.structure_content(spark.createDataFrame(rows, ENRICHED), provider=provider, log=str(tmp_path / "log")).collect()
    assert len(got) == 3 and all(r.ok for r in got) and seen.read_text() == "x"


def test_texts_are_dealt_out_once_by_page(spark):
    """With modules and courses too large to broadcast, the join to the context is the content's only exchange."""
    content = spark.createDataFrame([("a", 1, "u", "one"), ("a", 9, "u9", "two"), ("b", None, "u0", "three"), (None, 1, "ux", "")],
                                    "course_id string, page_id bigint, url string, markdown string")
    pages = spark.createDataFrame([("a", 1, "P", "pu", "lecture", "m")],
                                  "course_id string, page_id bigint, title string, url string, content_type string, module_id string")
    modules = spark.createDataFrame([("a", "m", "Mod")], "course_id string, module_id string, module_title string")
    courses = spark.createDataFrame([("a", "A"), ("b", "B")], "course_id string, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = structure.enrich_context(content, pages, modules, courses)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange" in line for line in plan.split("\n")) == 8  # seven of small columns, one of the content
        got = {(r["course_id"], r["page_id"]): (r["course_name"], r["module_name"], r["title"], r["url"], r["ok"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {("a", 1): ("A", "Mod", "P", "pu", True), ("a", 9): ("A", "Unknown Module", "Unknown", "u9", True),
                   ("b", None): ("B", "Unknown Module", "Unknown", "u0", True),
                   (None, 1): (None, "Unknown Module", "Unknown", "ux", False)}


def test_requests_of_several_tasks_read_the_pages_once(spark):
    df = spark.createDataFrame([("c", 1, "x" * 9000, "T", "u", "A", "M"), ("c", 2, "", None, None, None, None)],
                               "course_id string, page_id bigint, markdown string, title string, url string, "
                               "course_name string, module_name string")
    tasks = ("classify", "structure", "summarize")
    every = structure.build_llm_requests(df, tasks)
    assert every._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    one_by_one = [tuple(r) for t in tasks for r in structure.build_llm_requests(df, t).collect()]
    assert sorted(map(tuple, every.collect())) == sorted(one_by_one)
