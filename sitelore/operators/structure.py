"""Structuring: context enrichment, prompt batches, model-output parsing and the provider hook.

The default provider is *extractive* and runs as native column expressions (no model, no
Python): title from the page, summary = first three sentences, key concepts = bold spans,
definitions = ``**term**: text`` lines, formulas = ``$…$`` spans, and bullets under headings
named like objectives / prerequisites / examples / quiz topics. A user provider (a callable on
a pandas DataFrame of requests returning raw response texts) runs through ``mapInPandas``;
its output goes through the same ``extract_llm_json`` → ``parse_structured`` path as a remote
model's would.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.functions import rules, urls
from sitelore.functions.exprs import let
from sitelore.session import cut_lineage

# ---------------------------------------------------------------- fixed values
CONTEXT_LIMITS = {"classify": 2000, "structure": 8000, "summarize": 6000}
CLASSIFY_TEMPLATE = ["Classify the following course page content.\n\nPage title: ", "title",
                     "\nPage URL: ", "url", "\n\nContent (first 2000 chars):\n", "content", "\n"]
STRUCTURE_TEMPLATE = ["Extract structured knowledge from this course page.\n\nCourse: ", "course_name",
                      "\nModule: ", "module_name", "\nPage title: ", "title", "\nPage URL: ", "url",
                      "\n\nContent:\n", "content", "\n"]
SUMMARIZE_TEMPLATE = ["Summarize the following course content:\n\nTitle: ", "title", "\nContent:\n", "content", "\n"]
TEMPLATES = {"classify": CLASSIFY_TEMPLATE, "structure": STRUCTURE_TEMPLATE, "summarize": SUMMARIZE_TEMPLATE}
TEMPLATE_DEFAULTS = {
    "classify": {"title": "Unknown", "url": "Unknown"},
    "structure": {"course_name": "Unknown", "module_name": "Unknown", "title": "Unknown", "url": ""},
    "summarize": {"title": ""},
}
UNKNOWN_MODULE = "Unknown Module"
UNKNOWN_TITLE = "Unknown"
LIST_FIELDS = ["learning_objectives", "key_concepts", "examples", "important_formulas", "prerequisites", "quiz_topics"]
STRING_FIELDS = ["title", "course", "module", "summary", "source_url"]
# Headings whose bullets feed a list field in the extractive provider (own choice).
SECTION_FIELDS = {
    "learning_objectives": r"(?i)objective|outcome",
    "prerequisites": r"(?i)prerequisite|requirement",
    "examples": r"(?i)example",
    "quiz_topics": r"(?i)quiz|review",
}
# ---------------------------------------------------------------- end of fixed values

STRUCTURED_SCHEMA = (
    "struct<title:string,course:string,module:string,content_type:string,"
    + ",".join(f"{f}:array<string>" for f in LIST_FIELDS[:2])
    + ",definitions:array<struct<term:string,definition:string>>,"
    + ",".join(f"{f}:array<string>" for f in LIST_FIELDS[2:])
    + ",summary:string,source_url:string>"
)
WS_RUN = r"[\t\n\x{0b}\x{0c}\r ]+"
SENTENCE = r"[^.!?]+[.!?]*"


def enrich_context(content: DataFrame, pages: DataFrame, modules: DataFrame, courses: DataFrame) -> DataFrame:
    """Per scraped page: course name, module title, page title, url and type via three left joins
    (instead of one lookup per page). Empty markdown is kept with ``ok = false`` (failed).

    The three joins run on the distinct keys of the content; the content, which holds the texts, is joined to their
    result and so dealt out once, by (site, page), however large modules and courses are.
    """
    p = pages.select("course_id", "page_id", F.lit(True).alias("_has_page"), F.col("title").alias("_ptitle"),
                     F.col("url").alias("_purl"), F.col("content_type").alias("_ptype"), "module_id")
    m = modules.select("course_id", "module_id", "module_title")
    c = courses.select("course_id", F.col("name").alias("course_name"))
    keys = content.select("course_id", "page_id").distinct()
    context = keys.join(p, ["course_id", "page_id"], "left").join(m, ["course_id", "module_id"], "left").join(
        c, "course_id", "left").drop("module_id").withColumnsRenamed({"course_id": "_course", "page_id": "_page"})
    j = content.join(context, F.col("course_id").eqNullSafe(F.col("_course")) & F.col("page_id").eqNullSafe(
        F.col("_page")), "left")
    has_page = F.coalesce(F.col("_has_page"), F.lit(False))
    return j.select(
        "page_id", "course_id", "course_name",
        F.coalesce(F.col("module_title"), F.lit(UNKNOWN_MODULE)).alias("module_name"),
        F.when(has_page, F.col("_ptitle")).otherwise(F.lit(UNKNOWN_TITLE)).alias("title"),
        F.when(has_page, F.col("_purl")).otherwise(F.col("url")).alias("url"),
        F.when(has_page, F.col("_ptype")).otherwise(F.lit("other")).alias("content_type"),
        "markdown",
        (F.coalesce(F.col("markdown"), F.lit("")) != "").alias("ok"),
    )


def build_llm_requests(df: DataFrame, task: str | Sequence[str], limit: int | None = None) -> DataFrame:
    """Prompts of each row for ``classify`` / ``structure`` / ``summarize``: the whole content goes out in numbered
    requests (``part`` from 0) of at most the task's number of code points; missing context values get defaults.

    Of several tasks each gets its requests, and ``df`` is read once for all of them. ``limit`` is for callers that want
    a cut: only the first ``limit`` code points, in one request.
    """
    tasks = [task] if isinstance(task, str) else list(task)
    text = F.coalesce(F.col("markdown"), F.lit(""))

    def pieces(name: str) -> Column:
        size = CONTEXT_LIMITS[name] if limit is None else limit
        # one pass over the text cuts all parts; a text of no characters is one empty part
        return (F.array(F.substring(text, F.lit(1), F.lit(size))) if limit is not None else F.when(
            text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0)))

    def prompt(name: str) -> Column:
        defaults = TEMPLATE_DEFAULTS[name]
        parts: list[Column] = []
        for piece in TEMPLATES[name]:
            if piece == "content":
                parts.append(F.col("_content"))
            elif piece in defaults or piece in ("title", "url", "course_name", "module_name"):
                parts.append(F.coalesce(F.col(piece), F.lit(defaults.get(piece, ""))))
            else:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    def by_task(of: Callable[[str], Column]) -> Column:
        if len(tasks) == 1:
            return of(tasks[0])
        return F.coalesce(*[F.when(F.col("task") == name, of(name)) for name in tasks])

    named = F.lit(tasks[0]) if len(tasks) == 1 else F.explode(F.array(*[F.lit(name) for name in tasks]))
    df = df.select(*[c for c in df.columns if c != "task"], named.alias("task"))
    df = df.select("*", F.posexplode(by_task(pieces)).alias("part", "_content"))
    return df.select("course_id", "page_id", "task", "part", by_task(prompt).alias("prompt"))


def extract_llm_json(df: DataFrame, text_col: str = "response") -> DataFrame:
    """Model text → ``json_text``: trimmed; code-fence lines dropped when it starts with a fence;
    parsed as is, else the span from the first '{' to the last '}'; NULL when neither parses."""

    def unfence(t: Column) -> Column:
        return F.when(
            t.startswith("```"),
            F.array_join(F.filter(F.split(t, "\n"), lambda line: ~urls.py_strip(line).startswith("```")), "\n"),
        ).otherwise(t)

    def pick(u: Column) -> Column:
        start = F.instr(u, "{")
        from_end = F.instr(F.reverse(u), "}")
        last = F.length(u) - from_end + 1
        span = F.substring(u, start, last - start + 1)
        has_span = (start > 0) & (from_end > 0) & (last > start)
        return F.when(F.try_parse_json(u).isNotNull(), u).when(has_span & F.try_parse_json(span).isNotNull(), span)

    return df.withColumn("json_text", let(urls.py_strip(F.col(text_col)), lambda t: let(unfence(t), pick)))


def _is_str(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def parse_structured(df: DataFrame, json_col: str = "json_text") -> DataFrame:
    """JSON → structured record with the reference's defaults and strictness.

    Missing keys take defaults (context title/course/module/url, '' or []); an explicit null,
    a wrong type (e.g. a number in a string list) or an unknown ``content_type`` fails the row
    (``ok = false``, ``error`` says which field). Needs context columns ``title, course_name,
    module_name, url``. ``source_url`` is always the page URL.
    """
    ctx = {"title": F.col("title"), "course": F.coalesce(F.col("course_name"), F.lit("")),
           "module": F.coalesce(F.col("module_name"), F.lit("")), "summary": F.lit(""),
           "source_url": F.coalesce(F.col("url"), F.lit(""))}

    def build(v: Column) -> Column:
        is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

        def field(name: str) -> Column:
            return F.variant_get(v, f"$.{name}", "variant")

        checks: list[tuple[str, Column]] = []
        values: dict[str, Column] = {}
        for name in STRING_FIELDS:
            f = field(name)
            checks.append((name, f.isNull() | _is_str(f)))
            values[name] = F.when(f.isNull(), ctx[name]).otherwise(F.try_variant_get(v, f"$.{name}", "string"))
        ct = field("content_type")
        ct_val = F.when(ct.isNull(), F.lit("other")).otherwise(F.try_variant_get(v, "$.content_type", "string"))
        checks.append(("content_type", (ct.isNull() | _is_str(ct)) & ct_val.isin(rules.CONTENT_TYPES)))
        values["content_type"] = ct_val
        for name in LIST_FIELDS:
            f = field(name)
            arr = F.try_variant_get(v, f"$.{name}", "array<variant>")
            checks.append((name, f.isNull() | (arr.isNotNull() & F.forall(arr, lambda e: _is_str(e)))))
            values[name] = F.when(f.isNull(), F.array().cast("array<string>")).otherwise(
                F.try_variant_get(v, f"$.{name}", "array<string>"))
        defs = field("definitions")
        darr = F.try_variant_get(v, "$.definitions", "array<variant>")
        checks.append(("definitions", defs.isNull() | (darr.isNotNull() & F.forall(
            darr, lambda e: F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False))))))
        values["definitions"] = F.when(
            defs.isNull(), F.array().cast("array<struct<term:string,definition:string>>")).otherwise(
            F.transform(darr, lambda e: F.struct(F.try_variant_get(e, "$.term", "string").alias("term"),
                                                 F.try_variant_get(e, "$.definition", "string").alias("definition"))))
        values["source_url"] = ctx["source_url"]
        error = F.when(~is_obj, F.lit("not a JSON object"))
        for name, ok in checks:
            error = error.when(~F.coalesce(ok, F.lit(False)), F.lit(f"invalid {name}"))
        order = ["title", "course", "module", "content_type", "learning_objectives", "key_concepts", "definitions",
                 "examples", "important_formulas", "prerequisites", "quiz_topics", "summary", "source_url"]
        record = F.struct(*[values[k].alias(k) for k in order])
        return F.struct(error.alias("error"), F.when(error.isNull(), record).alias("structured"))

    parsed = df.withColumn("_r", let(F.try_parse_json(F.col(json_col)), build))
    return parsed.select(*[c for c in df.columns if c not in ("error", "ok", "structured")],
                         F.col("_r.error").alias("error"), F.col("_r.error").isNull().alias("ok"),
                         F.col("_r.structured").alias("structured"))


def parse_classification(df: DataFrame, json_col: str = "json_text") -> DataFrame:
    """JSON → ``content_type`` (default other), ``confidence`` (default 0.5; numbers, booleans and
    numeric strings accepted), ``reasoning``; any failure → ('other', 0.0, 'Classification failed')."""
    v = F.try_parse_json(F.col(json_col))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    ct = F.variant_get(v, "$.content_type", "variant")
    ct_val = F.when(ct.isNull(), F.lit("other")).otherwise(F.try_variant_get(v, "$.content_type", "string"))
    ct_ok = (ct.isNull() | _is_str(ct)) & ct_val.isin(rules.CONTENT_TYPES)
    conf = F.variant_get(v, "$.confidence", "variant")
    conf_kind = F.schema_of_variant(conf)
    conf_val = (F.when(conf.isNull(), F.lit(0.5))
                 .when(conf_kind == "BOOLEAN", F.try_variant_get(v, "$.confidence", "boolean").cast("double"))
                 .when(conf_kind == "STRING", F.try_variant_get(v, "$.confidence", "string").try_cast("double"))
                 .otherwise(F.try_variant_get(v, "$.confidence", "double")))
    reason = F.variant_get(v, "$.reasoning", "variant")
    reason_ok = reason.isNull() | _is_str(reason) | (F.schema_of_variant(reason) == "VOID")
    ok = is_obj & F.coalesce(ct_ok, F.lit(False)) & conf_val.isNotNull() & reason_ok
    return df.select(
        *[c for c in df.columns],
        F.when(ok, ct_val).otherwise(F.lit("other")).alias("cls_content_type"),
        F.when(ok, conf_val).otherwise(F.lit(0.0)).alias("cls_confidence"),
        F.when(ok, F.try_variant_get(v, "$.reasoning", "string")).otherwise(F.lit("Classification failed")).alias(
            "cls_reasoning"),
    )


def _sentences(text: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), WS_RUN, " ")
    return F.regexp_extract_all(flat, F.lit(SENTENCE), 0)


def summarize(df: DataFrame, text_col: str = "markdown", provider: Callable | None = None,
              partitions: int | None = None) -> DataFrame:
    """Extractive summary: the first three sentences ('' when there is no text).

    A ``provider`` (see ``structure_content``) writes one for each part of an enriched page; they
    are joined in order, and a failed part adds nothing.
    """
    if provider is not None:
        key = ["course_id", "page_id"]
        parts = provider_responses(df.filter("ok"), "summarize", provider, partitions)
        joined = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "response"))).alias("_p")).select(
            *key, F.array_join(F.filter(F.transform("_p.response", urls.py_strip), lambda x: x != ""), " ").alias("summary"))
        return df.join(joined, key, "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    return df.withColumn("summary", urls.py_strip(F.array_join(F.slice(_sentences(F.col(text_col)), 1, 3), "")))


def _section_bullets(md: Column, heading_re: str) -> Column:
    """Bullets (``- x`` / ``* x``) of every section whose heading matches ``heading_re``."""
    sections = F.split(F.concat(F.lit("\n"), md), r"\n#{1,6} ")
    picked = F.filter(F.slice(sections, F.lit(2), F.greatest(F.size(sections) - 1, F.lit(0))),
                      lambda s: F.substring_index(s, "\n", 1).rlike(heading_re))
    bullets = F.transform(picked, lambda s: F.regexp_extract_all(s, F.lit(r"\n[-*] +([^\n]+)"), 1))
    return F.flatten(bullets)


def structure_extractive(df: DataFrame) -> DataFrame:
    """Default provider: structured record from the markdown itself (see module docstring)."""
    md = F.coalesce(F.col("markdown"), F.lit(""))
    defs = F.regexp_extract_all(md, F.lit(r"(?m)^\*\*([^*\n]+)\*\*:[ \t]*([^\n]+)$"), 1)
    def_texts = F.regexp_extract_all(md, F.lit(r"(?m)^\*\*([^*\n]+)\*\*:[ \t]*([^\n]+)$"), 2)
    record = F.struct(
        F.col("title").alias("title"),
        F.coalesce(F.col("course_name"), F.lit("")).alias("course"),
        F.coalesce(F.col("module_name"), F.lit("")).alias("module"),
        F.coalesce(F.col("content_type"), F.lit("other")).alias("content_type"),
        _section_bullets(md, SECTION_FIELDS["learning_objectives"]).alias("learning_objectives"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(md, F.lit(r"\*\*([^*]+)\*\*"), 1))).alias("key_concepts"),
        F.transform(F.arrays_zip(defs.alias("term"), def_texts.alias("definition")),
                    lambda e: F.struct(e["term"].alias("term"), e["definition"].alias("definition"))).alias("definitions"),
        _section_bullets(md, SECTION_FIELDS["examples"]).alias("examples"),
        F.regexp_extract_all(md, F.lit(r"\$([^$]+)\$"), 1).alias("important_formulas"),
        _section_bullets(md, SECTION_FIELDS["prerequisites"]).alias("prerequisites"),
        _section_bullets(md, SECTION_FIELDS["quiz_topics"]).alias("quiz_topics"),
        urls.py_strip(F.array_join(F.slice(_sentences(md), 1, 3), "")).alias("summary"),
        F.coalesce(F.col("url"), F.lit("")).alias("source_url"),
    )
    return df.withColumn("structured", F.when(F.col("ok"), record)).withColumn(
        "error", F.when(~F.col("ok"), F.lit("empty content")))


def structure_content(df: DataFrame, provider: Callable | None = None, partitions: int | None = None,
                      log: str | None = None) -> DataFrame:
    """Structured record per enriched page. ``provider=None`` → native extractive default.

    A user ``provider(pdf) -> iterable of response strings`` receives pandas batches with
    ``course_id, page_id, part, prompt`` and runs inside ``mapInPandas``; ``partitions`` bounds its
    parallelism and ``log`` names a response log (``provider_responses``). The records of a page's parts are
    merged; a part that failed or has no valid record fails its page, with its error.
    """
    if provider is None:
        return structure_extractive(df)
    key = ["course_id", "page_id"]
    responses = provider_responses(df.filter("ok"), "structure", provider, partitions, log).withColumnRenamed(
        "error", "_failed")
    context = df.select(*key, "course_name", "module_name", "title", "url")
    parsed = parse_structured(extract_llm_json(responses.join(context, key), "response"))
    parsed = parsed.withColumn("error", F.coalesce("_failed", "error"))
    merged = merge_parts(parsed).withColumn("_answered", F.lit(True))
    out = df.drop("ok", "error", "structured").join(merged, key, "left")
    return out.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn(
        "error", F.when(F.col("_answered"), F.col("error")).otherwise(F.lit("empty content"))).drop("_answered")


RESPONSES = "course_id string, page_id bigint, part int, request string, response string, error string"


def answers(requests: DataFrame, provider: Callable) -> DataFrame:
    """``RESPONSES`` of a provider. A batch that fails is asked again row by row, so only failing rows have an error."""
    def asked(pdf) -> list[tuple[str | None, str | None]]:
        try:
            out = list(provider(pdf.drop(columns="request")))
            if len(out) != len(pdf):
                raise ValueError(f"{len(out)} responses to {len(pdf)} requests")
            return [(r, None) for r in out]
        except Exception as failed:  # noqa: BLE001 - the error goes with its row, the job goes on
            if len(pdf) == 1:
                return [(None, f"{type(failed).__name__}: {failed}")]
            return [asked(pdf.iloc[i:i + 1])[0] for i in range(len(pdf))]

    def run(batches):
        for pdf in batches:
            found = asked(pdf) if len(pdf) else []
            yield pdf[["course_id", "page_id", "part", "request"]].assign(
                response=[r for r, _ in found], error=[e for _, e in found])

    return requests.select("course_id", "page_id", "part", "request", "prompt").mapInPandas(run, RESPONSES)


class ResponseLog:
    """Responses under ``path``, by request (sha256 of task and prompt). Only ever appended to, a folder for each slice of
    requests that was asked to the end; a failed request is logged with its error and stays open."""

    SCHEMA = "request string, response string, error string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.globStatus(path(f"{self.path}/asked=*")) or []]
        done = [p.toString() for p in found if fs.exists(path(p, "_SUCCESS"))]
        return (self.spark.read.schema(self.SCHEMA).parquet(*done) if done
                else self.spark.createDataFrame([], self.SCHEMA))

    def answered(self) -> DataFrame:
        """request, response: one row for each answered request."""
        return self.rows().where("error IS NULL").groupBy("request").agg(F.min("response").alias("response"))

    def append(self, rows: DataFrame) -> None:
        rows.select("request", "response", "error").write.parquet(f"{self.path}/asked={uuid.uuid4().hex}")


def provider_responses(df: DataFrame, task: str, provider: Callable, partitions: int | None = None,
                       log: str | None = None, slices: int = 16) -> DataFrame:
    """``course_id, page_id, part, response, error`` of a user provider for every request of a task.

    With ``log`` (a folder on shared storage) responses are kept by request: what the log answers is not asked
    again, equal prompts are asked once, and requests go out in ``slices``, each logged when it is done, so a run that
    dies is continued by the next with at most one slice asked twice.
    """
    requests = build_llm_requests(df, task).withColumn("request", F.sha2(F.concat_ws("\n", F.lit(task), "prompt"), 256))

    def spread(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions) if partitions else rows

    columns = ["course_id", "page_id", "part", "response", "error"]
    if log is None:
        return answers(spread(requests), provider).select(*columns)
    kept = ResponseLog(df.sparkSession, log)
    requests = cut_lineage(requests, name="requests")
    one = requests.groupBy("request").agg(F.min_by(F.struct("course_id", "page_id", "part", "prompt"), F.struct(
        "course_id", "page_id", "part")).alias("r")).select("request", "r.*")
    todo = cut_lineage(one.join(kept.answered(), "request", "left_anti").withColumn(
        "slice", F.pmod(F.xxhash64("request"), F.lit(slices))), name="unanswered")
    for r in todo.select("slice").distinct().orderBy("slice").collect():  # at most ``slices`` numbers
        kept.append(answers(spread(todo.where(F.col("slice") == r["slice"])), provider))
    failed = kept.rows().where("error IS NOT NULL").groupBy("request").agg(F.max("error").alias("error"))
    return (requests.join(kept.answered(), "request", "left").join(failed, "request", "left")
            .withColumn("error", F.when(F.col("response").isNull(), F.col("error"))).select(*columns))


def merge_parts(parsed: DataFrame) -> DataFrame:
    """One record per page of the records of its parts (``part``): the first part's title, course, module, type and
    URL, every part's lists without repeats, and the summaries one after another."""
    s = F.col("_s")

    def every(name: str) -> Column:
        return F.array_distinct(F.flatten(s[name])).alias(name)

    pages = parsed.groupBy("course_id", "page_id").agg(
        F.bool_and("ok").alias("ok"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("part"))).alias("error"),
        F.array_sort(F.collect_list(F.struct("part", "structured"))).alias("_parts"),  # bounded by the page's text
    ).withColumn("_s", F.col("_parts.structured"))
    record = F.struct(
        *[s[0][name].alias(name) for name in ("title", "course", "module", "content_type")],
        *[every(name) for name in LIST_FIELDS[:2]], every("definitions"), *[every(name) for name in LIST_FIELDS[2:]],
        F.array_join(F.filter(s["summary"], lambda x: x != ""), " ").alias("summary"), s[0]["source_url"].alias("source_url"))
    return pages.select("course_id", "page_id", "ok", "error", F.when(F.col("ok"), record).alias("structured"))


def classify_content(df: DataFrame, provider: Callable | None = None, partitions: int | None = None) -> DataFrame:
    """Default classifier: title rules over the title and the whole content.

    A ``provider`` (see ``structure_content``) types each part of an enriched page; the surest
    part decides, the earlier one of equals.
    """
    if provider is not None:
        key = ["course_id", "page_id"]
        parts = parse_classification(extract_llm_json(
            provider_responses(df.filter("ok"), "classify", provider, partitions)))
        best = parts.groupBy(*key).agg(F.max_by(
            F.struct("cls_content_type", "cls_confidence", "cls_reasoning"),
            F.struct("cls_confidence", -F.col("part"))).alias("_b")).select(*key, "_b.*")
        return df.join(best, key, "left")
    text = F.concat_ws(" ", F.col("title"), F.coalesce(F.col("markdown"), F.lit("")))
    ctype = rules.classify_content_type(F.lit(""), text, F.lit(""))
    return df.withColumn("cls_content_type", ctype).withColumn(
        "cls_confidence", F.when(ctype != "other", F.lit(0.5)).otherwise(F.lit(0.0))).withColumn(
        "cls_reasoning", F.when(ctype != "other", F.lit("keyword rule")).otherwise(F.lit("no rule matched")))


def resolve_ambiguous(pages: DataFrame, classified: DataFrame) -> DataFrame:
    """Pages typed ``other`` take the model's type (``cls_content_type`` by site and page)."""
    cls = classified.select("course_id", "page_id", "cls_content_type")
    j = pages.join(cls, ["course_id", "page_id"], "left")
    amb = (F.col("content_type") == "other") & F.col("cls_content_type").isNotNull()
    return j.withColumn("type_source", F.when(amb, F.lit("model")).otherwise(F.lit("rules"))).withColumn(
        "content_type", F.when(amb, F.col("cls_content_type")).otherwise(F.col("content_type"))).drop("cls_content_type")


def current_structured(parsed: DataFrame, version_col: str = "version") -> DataFrame:
    """Many versions per page → the last valid one; ``pos`` = first valid version (dict insertion)."""
    good = parsed.filter("ok")
    return good.groupBy("course_id", "page_id").agg(
        F.max_by("structured", F.col(version_col)).alias("structured"), F.min(version_col).alias("pos"),
    ).select("page_id", "course_id", "structured", "pos")
