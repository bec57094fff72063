"""Deterministic inputs derived from the driver tables (FIXTURES.md), for Spark and for DuckDB.

Each derived table is one SQL text with ``@table@`` references. Spark runs it through
``spark.sql(text, table=DataFrame)`` (so it is planned together with the consumer and
all pushdowns apply); the DuckDB oracle inlines the same text as a CTE. Only timestamp
arithmetic differs by dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def ts_minutes(expr: str, dialect: str) -> str:
    """TIMESTAMP '2024-01-01 00:00:00' plus ``expr`` minutes (timestamp without zone)."""
    if dialect == "spark":
        return f"timestampadd(MINUTE, CAST({expr} AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')"
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({expr} AS INT)))"


def _s(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(20))"


# ---------------------------------------------------------------- F1 links
def links_sql(dialect: str) -> str:
    return """
WITH p AS (
  SELECT page_id, html,
         CAST(floor(page_id / 24) AS BIGINT) AS c,
         CAST(page_id % 12 AS BIGINT) AS kind,
         CAST(1 + floor((page_id % 24) / 12) AS BIGINT) AS m
  FROM @pages@),
b AS (
  SELECT page_id, c, kind,
         concat('site', CAST(c AS VARCHAR(20)), '.example.edu') AS host,
         concat(CASE WHEN c % 2 = 0 THEN '/course/module-' ELSE '/course/part-' END, CAST(m AS VARCHAR(20))) AS md,
         CAST(page_id AS VARCHAR(20)) AS k,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_title
  FROM p),
l AS (
  SELECT page_id, c, kind, host,
    CASE kind
      WHEN 0 THEN CASE WHEN c % 2 = 0 THEN concat(md, '/') ELSE concat(md, '/about-', k) END
      WHEN 1 THEN concat(md, '/lecture-', k)
      WHEN 2 THEN concat(md, '/quiz_', k, '.html')
      WHEN 3 THEN concat(md, '/assignment;v=', k)
      WHEN 4 THEN concat(md, '/notes/', k, '.PDF')
      WHEN 5 THEN CASE WHEN c % 4 = 0 THEN concat(md, '/week-2/reading/', k, '/') ELSE concat(md, '/reading/', k, '/') END
      WHEN 6 THEN CASE WHEN c % 3 = 0 THEN '' ELSE concat('/syllabus?v=', k) END
      WHEN 7 THEN concat('/course/page', k, '?next=/login')
      WHEN 8 THEN concat(md, '/lab-', k, '#part')
      WHEN 9 THEN CASE WHEN c % 2 = 0 THEN concat('/media/clip_', k, '.mp4') ELSE concat('/news/', k) END
      WHEN 10 THEN concat('/blog/hw2solutions don''t ', k)
      ELSE CASE WHEN c % 4 = 0 THEN concat(md, '/week-2') ELSE concat('/files/deck-', k, '.pptx') END END AS path,
    CASE WHEN kind = 10 AND c % 2 = 0 THEN concat('Midterm ', k)
         WHEN kind = 10 THEN concat('Hands-on LAB ', k)
         WHEN page_id % 7 = 0 THEN NULL
         WHEN page_id % 7 = 1 THEN '' ELSE raw_title END AS title
  FROM b),
v AS (
  SELECT c, page_id * 8 AS ord, concat('https://', host, path) AS url, title FROM l
  UNION ALL
  SELECT c, page_id * 8 + 1, concat('https://', upper(host), path, '/'), title FROM l WHERE page_id % 5 = 0
  UNION ALL
  SELECT c, page_id * 8 + 2, replace(concat('https://', host, path), '#part', ''), title FROM l WHERE kind = 8 AND c % 2 = 0
  UNION ALL
  SELECT c, page_id * 8 + 3, replace(concat('https://', host, path), '#part', '-b'), title FROM l WHERE kind = 8
  UNION ALL
  SELECT c, page_id * 8 + 4, concat('https://other.example.org', path), title FROM l WHERE page_id % 11 = 0
  UNION ALL
  SELECT c, page_id * 8 + 5, concat('http://www.', host, path), title FROM l WHERE page_id % 10 = 3
  UNION ALL
  SELECT c, page_id * 8 + 6, concat('HTTPS://', host, path, '-x'), title FROM l WHERE page_id % 30 = 7
  UNION ALL
  SELECT c, page_id * 8 + 7, concat('https://account.', host, path), title FROM l WHERE page_id % 30 = 1)
SELECT concat('c', CAST(c AS VARCHAR(20))) AS course_id, CAST(ord AS BIGINT) AS ord, url, title FROM v
"""


# ---------------------------------------------------------------- courses (one row per site of F1)
def courses_sql(dialect: str) -> str:
    created = ts_minutes("c * 60", dialect)
    statuses = ", ".join(f"'{s}'" for s in ["created", "discovering", "discovered", "ingesting", "ingested",
                                            "processing", "processed", "exporting", "exported", "failed"])
    pick = "list_element" if dialect == "duckdb" else "element_at"
    arr = f"[{statuses}]" if dialect == "duckdb" else f"array({statuses})"
    return f"""
SELECT concat('c', CAST(c AS VARCHAR(20))) AS course_id,
       concat('Course ', CAST(c AS VARCHAR(20))) AS name,
       concat('https://site', CAST(c AS VARCHAR(20)), '.example.edu/') AS url,
       {pick}({arr}, CAST(c % 10 AS INT) + 1) AS status,
       {created} AS created_at
FROM (SELECT DISTINCT CAST(floor(page_id / 24) AS BIGINT) AS c FROM @pages@) t
"""


# ---------------------------------------------------------------- F2 content
def content_sql(dialect: str) -> str:
    ts = ts_minutes("doc_id", dialect)
    return f"""
SELECT doc_id AS page_id, concat('c', CAST(doc_id % 10 AS VARCHAR(20))) AS course_id,
       concat('https://site', CAST(doc_id % 10 AS VARCHAR(20)), '.example.edu/p/', CAST(doc_id % 70 AS VARCHAR(20))) AS url,
       text AS markdown, {ts} AS retrieved_at
FROM @documents@
"""


# ---------------------------------------------------------------- F3 page_content
def page_content_sql(dialect: str) -> str:
    """Every document stands on a stored page (kinds 6 to 8 can be rejected and get a copy beside it); a page holds
    the whole texts of its documents."""
    texts = ("listagg(text, concat(chr(10), chr(10))) WITHIN GROUP (ORDER BY doc_id)" if dialect == "spark"
             else "string_agg(text, concat(chr(10), chr(10)) ORDER BY doc_id)")
    return f"""
WITH k AS (
  SELECT course_id, ord, url, CAST(floor(ord / 96) AS BIGINT) AS dozen, CAST(floor(ord / 8) AS BIGINT) % 12 AS kind
  FROM @links@ WHERE ord % 8 = 0),
places AS (
  SELECT course_id, ord, url, kind BETWEEN 6 AND 8 AS beside,
         dozen * 9 + kind - CASE WHEN kind > 8 THEN 3 WHEN kind > 5 THEN 6 ELSE 0 END AS place
  FROM k),
d AS (
  SELECT doc_id, text, doc_id % (SELECT count(*) FROM places WHERE NOT beside) AS place FROM @documents@),
t AS (SELECT place, {texts} AS markdown FROM d GROUP BY place)
SELECT p.course_id, p.ord AS page_id, p.url, t.markdown FROM places p JOIN t ON t.place = p.place
"""


def scraped_sql(dialect: str) -> str:
    """F3 with a retrieval time (minutes after 2024-01-01 by page id), for the export documents."""
    ts = ts_minutes("page_id", dialect)
    return f"SELECT course_id, page_id, url, markdown, {ts} AS retrieved_at FROM @page_content@"


# ---------------------------------------------------------------- F4 llm_responses and versions
def llm_responses_sql(dialect: str) -> str:
    """A response for every document, made of the words at the start, quarters and end of its text; one in four has no
    JSON, one in four a fence, one in four words around it; every ninth an unknown type."""
    chr10 = "chr(10)"
    words = ("regexp_extract_all(coalesce(text, ''), '[a-z]{4,12}', 0)" if dialect == "spark"
             else "regexp_extract_all(coalesce(text, ''), '[a-z]{4,12}')")
    size = "size(w)" if dialect == "spark" else "len(w)"

    def word(quarter: int) -> str:
        at = f"CAST(floor({size} * {quarter} / 4) AS INT) - {0 if quarter == 0 else 1}"
        found = f"get(w, {at})" if dialect == "spark" else f"list_element(w, {at} + 1)"
        return f"coalesce({found}, 'none')"

    return f"""
SELECT doc_id * 8 AS page_id, concat('c', CAST(CAST(floor(doc_id / 24) AS BIGINT) AS VARCHAR(20))) AS course_id,
 CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN j
   WHEN 1 THEN concat('```json', {chr10}, j, {chr10}, '```')
   WHEN 2 THEN concat('Here it is: ', j, ' done') ELSE 'no json' END AS response
FROM (SELECT doc_id, concat('{{"title":"The ', w0, ' of ', w4, '","content_type":"',
   CASE WHEN doc_id % 9 = 0 THEN 'bogus' WHEN doc_id % 2 = 0 THEN 'lecture' ELSE 'quiz' END,
   '","key_concepts":["', w1, '","', upper(w1), '","', w2,
   '"],"definitions":[{{"term":"', w2, '","definition":"as in ', w1, ' ', w3, CAST(doc_id AS VARCHAR(20)),
   '"}},{{"term":"","definition":"x"}}],',
   CASE WHEN doc_id % 3 = 1 THEN '' ELSE concat('"quiz_topics":["', w3, '"],"learning_objectives":["know ', w1,
     '"],"important_formulas":["f', CAST(doc_id % 5 AS VARCHAR(20)), '"],"prerequisites":["', w0, '"],"examples":["', w4, '"],')
     END, '"summary":"',
   CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('From ', w0, ' to ', w4, ' by ', w2, ', ', CAST(doc_id AS VARCHAR(20))) END,
   '"}}') AS j
  FROM (SELECT doc_id, {word(0)} AS w0, {word(1)} AS w1, {word(2)} AS w2, {word(3)} AS w3, {word(4)} AS w4
        FROM (SELECT doc_id, {words} AS w FROM @documents@) s) q) t
"""


def structured_versions_sql(dialect: str) -> str:
    return """
SELECT page_id, course_id, CAST(1 AS INT) AS version, response FROM @llm_responses@
UNION ALL
SELECT page_id, course_id, CAST(2 AS INT), concat('{"title":"V2","content_type":"lecture","summary":"v2-', CAST(page_id AS VARCHAR(20)), '"}')
FROM @llm_responses@ WHERE page_id % 80 = 0
"""


# ---------------------------------------------------------------- F5 job_events
def job_events_sql(dialect: str) -> str:
    return """
SELECT event_id, CAST(user_id AS BIGINT) AS job_id, concat('c', CAST(user_id % 10 AS VARCHAR(20))) AS course_id, ts,
 CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'scraped' WHEN 'error' THEN 'failed'
      WHEN 'signup' THEN 'processed' ELSE 'generated' END AS event
FROM @events@
"""


# ---------------------------------------------------------------- F6 links_bench
def links_bench_sql(dialect: str) -> str:
    return """
SELECT concat('c', CAST(l_suppkey AS VARCHAR(20))) AS course_id,
 CAST((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS BIGINT) AS ord,
 concat('https://site', CAST(l_suppkey AS VARCHAR(20)), '.example.edu/course/module-', CAST(l_linenumber AS VARCHAR(20)),
   CASE l_returnflag WHEN 'A' THEN '/lecture-' WHEN 'R' THEN '/quiz-' ELSE '/p-' END, CAST(l_partkey AS VARCHAR(20))) AS url,
 CAST(NULL AS VARCHAR(20)) AS title
FROM @lineitem@
"""


def courses_bench_sql(dialect: str) -> str:
    return """
SELECT concat('c', CAST(s_suppkey AS VARCHAR(20))) AS course_id,
       concat('Course ', CAST(s_suppkey AS VARCHAR(20))) AS name,
       concat('https://site', CAST(s_suppkey AS VARCHAR(20)), '.example.edu/') AS url
FROM @supplier@
"""


# ---------------------------------------------------------------- F7 payloads
def map_payloads_sql(dialect: str) -> str:
    return """
SELECT course_id, ord, CASE CAST(floor(ord / 8) % 6 AS INT)
   WHEN 0 THEN concat('{"links":["', url, '"]}')
   WHEN 1 THEN concat('{"links":[{"url":"', url, '","title":"t', CAST(ord AS VARCHAR(20)), '"}]}')
   WHEN 2 THEN concat('[{"link":"', url, '"},"', url, '2"]')
   WHEN 3 THEN '{"links":[{}]}' WHEN 4 THEN '{"links":[]}' ELSE 'not json' END AS payload
FROM @links@
"""


def scrape_payloads_sql(dialect: str) -> str:
    return """
SELECT course_id, ord, url, CASE CAST(floor(ord / 8) % 5 AS INT)
   WHEN 0 THEN concat('{"markdown":"m', CAST(ord AS VARCHAR(20)), '","title":"top","metadata":{"title":"meta","lang":"en"}}')
   WHEN 1 THEN '{"markdown":"m","title":"top","metadata":{"title":""}}'
   WHEN 2 THEN '{"markdown":"","metadata":{}}'
   WHEN 3 THEN '{"title":"top"}' ELSE 'not json' END AS payload
FROM @links@
"""


def crawl_payloads_sql(dialect: str) -> str:
    return """
SELECT course_id, ord, CASE CAST(floor(ord / 8) % 4 AS INT) WHEN 3 THEN '{"error":"late"}'
   ELSE concat('{"data":[{"markdown":"a","url":"', url, '","metadata":{"title":"T"}},{"markdown":"b","url":"x","metadata":{"url":"', url, '/2"}}]}') END AS payload
FROM @links@
"""


# ---------------------------------------------------------------- F8 selection
def selection_sql(dialect: str) -> str:
    return """
SELECT course_id, ord AS page_id FROM @links@ WHERE ord % 3 <> 0
"""


# name -> (sql builder, referenced tables)
FIXTURES = {
    "links": (links_sql, ["pages"]),
    "courses": (courses_sql, ["pages"]),
    "content": (content_sql, ["documents"]),
    "page_content": (page_content_sql, ["links", "documents"]),
    "scraped": (scraped_sql, ["page_content"]),
    "llm_responses": (llm_responses_sql, ["documents"]),
    "structured_versions": (structured_versions_sql, ["llm_responses"]),
    "job_events": (job_events_sql, ["events"]),
    "links_bench": (links_bench_sql, ["lineitem"]),
    "courses_bench": (courses_bench_sql, ["supplier"]),
    "map_payloads": (map_payloads_sql, ["links"]),
    "scrape_payloads": (scrape_payloads_sql, ["links"]),
    "crawl_payloads": (crawl_payloads_sql, ["links"]),
    "selection": (selection_sql, ["links"]),
}

_REF = re.compile(r"@([a-z_]+)@")


# ---------------------------------------------------------------- Spark side
class Tables:
    """Lazy access to driver tables and derived fixtures of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in DRIVER_TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in FIXTURES:
                builder, deps = FIXTURES[name]
                text = builder("spark").replace("{", "{{").replace("}", "}}")
                text = _REF.sub(lambda m: "{" + m.group(1) + "}", text)
                self._cache[name] = self.spark.sql(text, **{d: self[d] for d in deps})
            else:
                raise KeyError(name)
        return self._cache[name]



def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


# ---------------------------------------------------------------- DuckDB side
def duck_ctes(*names: str) -> str:
    """``WITH`` clause bodies defining the named fixtures (and their dependencies) for DuckDB."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in DRIVER_TABLES or n in order:
            return
        for d in FIXTURES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        text = _REF.sub(lambda m: m.group(1), FIXTURES[n][0]("duckdb"))
        parts.append(f"{n} AS ({text})")
    return ",\n".join(parts)
