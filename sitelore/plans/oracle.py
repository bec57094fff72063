"""SQL oracle: for each registered query, DuckDB SQL over the driver tables computing the same result.

The oracle is an independent formulation: window functions (``row_number``) where the Spark
side uses ``min_by``/``max_by`` aggregates, explicit prefix matching where Spark uses an
exploded equi-join, and so on. Fixture CTEs are inlined from ``sources.fixtures``.
"""

from __future__ import annotations

import re

from sitelore.functions import rules
from sitelore.plans import duck as d
from sitelore.sources.fixtures import duck_ctes

ORACLE: dict[str, str] = {}


def with_(fixtures: list[str], *ctes: str) -> str:
    parts = [duck_ctes(*fixtures)] if fixtures else []
    parts += [c for c in ctes if c]
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- shared CTEs
FRONTIER = f"""
fr AS (SELECT course_id, ord, {d.strip('url')} AS url, title FROM links),
fr2 AS (SELECT *, {d.canonical('url')} AS canonical FROM fr),
ranked AS (SELECT *, row_number() OVER (PARTITION BY course_id, canonical ORDER BY ord, url) AS rn,
                  count(*) OVER (PARTITION BY course_id, canonical) AS n_links FROM fr2),
dd AS (SELECT course_id, canonical, ord, url, title, n_links FROM ranked WHERE rn = 1),
cb AS (SELECT course_id, {d.base_domain('url')} AS course_base FROM courses),
dd2 AS (SELECT dd.*, coalesce(cb.course_base, '') AS course_base FROM dd LEFT JOIN cb USING (course_id)),
fl AS (SELECT course_id, canonical, ord, url, n_links,
          coalesce((starts_with(url, 'http://') OR starts_with(url, 'https://'))
                   AND NOT {rules.duck_deny_sql('url')}
                   AND (course_base = '' OR {d.base_domain('url')} = course_base), false) AS keep,
          {rules.duck_classify_sql(f"lower({d.path('url')})", 'title')} AS content_type,
          coalesce(nullif(title, ''), {d.title_from_url('url')}) AS title
       FROM dd2),
dpages AS (SELECT course_id, ord AS page_id, url, canonical, title, content_type FROM fl WHERE keep)
"""

# ---------------------------------------------------------------- 2.2 scalar expressions
ORACLE["url_parts"] = with_(["links"]) + f"""
SELECT course_id, ord, {d.scheme('url')} AS scheme, {d.netloc('url')} AS netloc, {d.hostname('url')} AS hostname,
       {d.path('url')} AS path, {d.params('url')} AS params, {d.query('url')} AS query, {d.fragment('url')} AS fragment
FROM links"""

ORACLE["base_domain"] = with_(["links"]) + f"SELECT course_id, ord, {d.base_domain('url')} AS base_domain FROM links"

ORACLE["canonical_url"] = with_(["links"]) + f"SELECT course_id, ord, {d.canonical(d.strip('url'))} AS canonical FROM links"

ORACLE["title_from_url"] = with_(["links"]) + f"SELECT course_id, ord, {d.title_from_url('url')} AS url_title FROM links"

ORACLE["is_relevant"] = with_(["links", "courses"]) + f"""
SELECT l.course_id, l.ord,
       coalesce((starts_with(l.url, 'http://') OR starts_with(l.url, 'https://'))
                AND NOT {rules.duck_deny_sql('l.url')}
                AND (coalesce(c.b, '') = '' OR {d.base_domain('l.url')} = c.b), false) AS relevant
FROM (SELECT course_id, ord, {d.strip('url')} AS url FROM links) l
LEFT JOIN (SELECT course_id, {d.base_domain('url')} AS b FROM courses) c USING (course_id)"""

ORACLE["classify_content_type"] = with_(["links"]) + f"""
SELECT course_id, ord, {rules.duck_classify_sql(f"lower({d.path('url')})", 'title')} AS content_type FROM links"""

# ---------------------------------------------------------------- frontier
ORACLE["dedupe_links"] = with_(["links", "courses"], FRONTIER) + "SELECT course_id, canonical, ord, url, title FROM dd"

ORACLE["discover_pages"] = with_(["links", "courses"], FRONTIER) + "SELECT * FROM dpages"


def _frontier_of(links: str, suffix: str) -> str:
    """FRONTIER over another link table, its names with a suffix."""
    named = re.sub(r"\b(fr2?|ranked|dd2?|cb|fl|dpages)\b", rf"\1_{suffix}", FRONTIER)
    return named.replace("FROM links)", f"FROM {links})").replace(f"ord AS page_id, url, canonical, title, content_type FROM fl_{suffix}",
                                                                  f"ord, url, canonical, title, content_type FROM fl_{suffix}")


ORACLE["rediscover_pages"] = with_(["links", "courses"], """
earlier AS (SELECT * FROM links WHERE CAST(floor(ord / 8) AS BIGINT) % 50 <> 9)""", """
again AS (SELECT course_id, url, CASE WHEN b % 30 = 4 THEN 'Again ' || CAST(b AS VARCHAR) ELSE title END AS title,
                 CASE WHEN b % 5 = 0 THEN ord ELSE ord + 3 END AS ord
          FROM (SELECT *, CAST(floor(ord / 8) AS BIGINT) AS b FROM links) x WHERE b % 40 <> 7)""",
    _frontier_of("earlier", "old"), _frontier_of("again", "new")) + """
SELECT coalesce(n.course_id, o.course_id) AS course_id, coalesce(n.canonical, o.canonical) AS canonical,
  CASE WHEN o.canonical IS NULL THEN 'added' WHEN n.canonical IS NULL THEN 'vanished'
       WHEN n.url IS DISTINCT FROM o.url OR n.title IS DISTINCT FROM o.title OR n.content_type IS DISTINCT FROM o.content_type THEN 'changed'
       WHEN n.ord <> o.ord THEN 'moved' ELSE 'kept' END AS change,
  CASE WHEN n.canonical IS NULL THEN o.url ELSE n.url END AS url, CASE WHEN n.canonical IS NULL THEN o.title ELSE n.title END AS title,
  CASE WHEN n.canonical IS NULL THEN o.content_type ELSE n.content_type END AS content_type, o.ord AS old_ord, n.ord AS new_ord
FROM dpages_old o FULL OUTER JOIN dpages_new n ON o.course_id = n.course_id AND o.canonical = n.canonical"""

_type_counts = ",\n".join(
    f"  CAST(count(*) FILTER (WHERE keep AND content_type = '{t}') AS BIGINT) AS n_{t}" for t in rules.CONTENT_TYPES)
ORACLE["discovery_stats"] = with_(["links", "courses"], FRONTIER) + f"""
SELECT course_id, CAST(sum(n_links) AS BIGINT) AS mapped, CAST(count(*) AS BIGINT) AS unique_urls,
  CAST(count(*) FILTER (WHERE keep) AS BIGINT) AS kept,
{_type_counts}
FROM fl GROUP BY course_id"""

ORACLE["limit_frontier"] = with_(["links"]) + """
SELECT course_id, ord, url, title FROM (
  SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY ord, url) AS rn FROM links) t WHERE rn <= 20"""

# ---------------------------------------------------------------- hierarchy
_cp = f"regexp_replace({d.path('url')}, '/+$', '')"
HIER = f"""
flags AS (SELECT course_id, bool_or(content_type = 'module') AS has_modules FROM dpages GROUP BY course_id),
ep AS (SELECT p.* FROM dpages p JOIN flags f USING (course_id) WHERE f.has_modules),
np AS (SELECT p.* FROM dpages p JOIN flags f USING (course_id) WHERE NOT f.has_modules),
emods0 AS (SELECT course_id, page_id, url, title, {_cp} AS module_path,
             row_number() OVER (PARTITION BY course_id ORDER BY url, coalesce(title, ''), page_id) - 1 AS order_index
           FROM ep WHERE content_type = 'module'),
emods AS (SELECT course_id, CAST(page_id AS VARCHAR) AS module_id,
             coalesce(nullif(title, ''), 'Module ' || CAST(order_index + 1 AS VARCHAR)) AS module_title,
             CAST(order_index AS BIGINT) AS order_index, module_path FROM emods0),
ecp AS (SELECT *, {_cp} AS cp FROM ep WHERE content_type <> 'module'),
eassigned AS (SELECT c.course_id, c.page_id, c.url, c.title, c.content_type, m.module_id, m.module_title, m.order_index
   FROM ecp c JOIN emods m ON c.course_id = m.course_id
   WHERE c.cp = m.module_path OR starts_with(c.cp, m.module_path || '/')),
nk AS (SELECT *, CASE WHEN len(segs) >= 2 THEN segs[len(segs) - 1] ELSE '_root' END AS module_key
       FROM (SELECT *, {d.segments('url')} AS segs FROM np) s),
dkeys AS (SELECT course_id, module_key,
             row_number() OVER (PARTITION BY course_id ORDER BY module_key) - 1 AS order_index,
             count(*) OVER (PARTITION BY course_id) AS n_keys
          FROM (SELECT DISTINCT course_id, module_key FROM nk) k),
dmods AS (SELECT course_id, course_id || '/' || module_key AS module_id, {d.humanize('module_key')} AS module_title,
             CAST(order_index AS BIGINT) AS order_index, module_key
          FROM dkeys WHERE module_key <> '_root' OR n_keys = 1),
dassigned AS (SELECT nk.course_id, nk.page_id, nk.url, nk.title, nk.content_type, m.module_id, m.module_title, m.order_index
   FROM nk JOIN dmods m ON nk.course_id = m.course_id AND nk.module_key = m.module_key),
hmods AS (SELECT course_id, module_id, module_title, order_index FROM emods
          UNION ALL SELECT course_id, module_id, module_title, order_index FROM dmods),
hassigned AS (SELECT * FROM eassigned UNION ALL SELECT * FROM dassigned),
huncl AS (SELECT p.* FROM dpages p WHERE NOT EXISTS
          (SELECT 1 FROM hassigned a WHERE a.course_id = p.course_id AND a.page_id = p.page_id)),
hier AS (SELECT m.course_id, m.module_id, m.module_title, m.order_index, a.page_id, a.url, a.title, a.content_type
         FROM hmods m LEFT JOIN hassigned a ON a.course_id = m.course_id AND a.module_id = m.module_id
         UNION ALL
         SELECT course_id, NULL, NULL, CAST(NULL AS BIGINT), page_id, url, title, content_type FROM huncl),
stored AS (SELECT p.course_id, p.page_id, s.module_id, p.url, p.title, p.content_type
           FROM dpages p LEFT JOIN (SELECT course_id, page_id, arg_max(module_id, (order_index, module_id)) AS module_id
                                    FROM hassigned GROUP BY course_id, page_id) s
           ON s.course_id = p.course_id AND s.page_id = p.page_id)
"""
HW = ["links", "courses"]

ORACLE["order_module_pages"] = with_(HW, FRONTIER, HIER) + "SELECT * FROM emods"
ORACLE["assign_pages_by_prefix"] = with_(HW, FRONTIER, HIER) + "SELECT * FROM eassigned"
ORACLE["detect_modules"] = with_(HW, FRONTIER, HIER) + \
    "SELECT course_id, module_id, module_title, order_index FROM dmods"
ORACLE["unclassified_pages"] = with_(HW, FRONTIER, HIER) + "SELECT * FROM huncl"
ORACLE["build_hierarchy"] = with_(HW, FRONTIER, HIER) + "SELECT * FROM hier"
ORACLE["course_counts"] = with_(HW, FRONTIER, HIER) + """
SELECT course_id, count(DISTINCT module_id) AS module_count, count(page_id) AS page_count FROM hier GROUP BY course_id"""
ORACLE["course_structure"] = with_(HW, FRONTIER, HIER) + """
SELECT m.course_id, m.module_id, m.module_title, m.order_index, s.page_id, s.url, s.title, s.content_type
FROM hmods m LEFT JOIN stored s ON s.course_id = m.course_id AND s.module_id = m.module_id
UNION ALL
SELECT course_id, module_id, NULL, CAST(NULL AS BIGINT), page_id, url, title, content_type FROM stored WHERE module_id IS NULL"""

# ---------------------------------------------------------------- sources + content
from sitelore.sources import html as _html  # noqa: E402


def _decode(x: str) -> str:
    out = x
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, {d.q(ent)}, {d.q(ch)})"
    return out


def _resolve(h: str, u: str) -> str:
    root = f"{d.scheme(u)} || '://' || {d.netloc(u)}"
    return (f"(CASE WHEN regexp_matches({h}, {d.q(r'^[A-Za-z][A-Za-z0-9+.\-]*:')}) THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {d.scheme(u)} || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {root} || {h} ELSE {root} || '/' || {h} END)")


ORACLE["extract_links"] = f"""
WITH a AS (SELECT page_id, url,
             list_transform(regexp_extract_all(html, {d.q(_html.ANCHOR_RE)}, 1),
                            lambda x: regexp_replace(x, {d.q(_html.QUOTES_RE)}, '', 'g')) AS hrefs,
             list_transform(regexp_extract_all(html, {d.q(_html.ANCHOR_RE)}, 2),
                            lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS texts FROM pages),
e AS (SELECT page_id, url, hrefs, texts, unnest(generate_series(1, len(hrefs))) AS i FROM a)
SELECT {d.base_domain('url')} AS course_id, page_id AS src_page, CAST(i - 1 AS BIGINT) AS pos,
       {_resolve(_decode('hrefs[i]'), 'url')} AS url, nullif({d.strip(_decode('texts[i]'))}, '') AS title
FROM e"""

_md = f"regexp_replace(html, {d.q(_html.DROP_BLOCKS_RE)}, '', 'g')"
for _lvl in range(1, 7):
    _md = f"regexp_replace({_md}, {d.q(rf'(?i)<h{_lvl}\b[^>]*>')}, chr(10) || {d.q('#' * _lvl + ' ')}, 'g')"
_md = f"regexp_replace({_md}, '(?i)</h[1-6]>', chr(10), 'g')"
_md = f"regexp_replace({_md}, {d.q(r'(?i)<li\b[^>]*>')}, chr(10) || '- ', 'g')"
_md = f"regexp_replace({_md}, {d.q(r'(?i)</?(b|strong)\b[^>]*>')}, '**', 'g')"
_md = f"regexp_replace({_md}, {d.q(r'(?i)<br\s*/?>')}, chr(10), 'g')"
_md = f"regexp_replace({_md}, {d.q(r'(?i)</?p\b[^>]*>')}, chr(10) || chr(10), 'g')"
_md = f"regexp_replace({_md}, '<[^>]*>', '', 'g')"
_md = _decode(_md)
_md = f"regexp_replace({_md}, {d.q(r'[ \t]+\n')}, chr(10), 'g')"
_md = f"regexp_replace({_md}, {d.q(r'\n{3,}')}, chr(10) || chr(10), 'g')"
_md = d.strip(_md)
ORACLE["extract_content"] = f"""
SELECT page_id, url, title, markdown, lang, url AS source_url, markdown <> '' AS success FROM (
  SELECT page_id, url, {d.strip(_decode(f"regexp_extract(html, {d.q(_html.TITLE_RE)}, 1)"))} AS title,
         {_md} AS markdown, regexp_extract(html, {d.q(_html.LANG_RE)}, 1) AS lang FROM pages) t"""

ORACLE["normalize_links"] = with_(["links", "map_payloads"], """
arrs AS (SELECT course_id, ord, CASE WHEN NOT json_valid(payload) THEN NULL
                                     WHEN json_type(payload) = 'OBJECT' THEN json_extract(payload, '$.links')
                                     ELSE json(payload) END AS arr FROM map_payloads),
el AS (SELECT course_id, ord, i - 1 AS pos, json_extract(arr, '$[' || CAST(i - 1 AS VARCHAR) || ']') AS e
       FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(arr) AS BIGINT))) AS i FROM arrs) x)
""") + """
SELECT course_id, ord, CAST(pos AS BIGINT) AS pos,
  CASE json_type(e) WHEN 'VARCHAR' THEN json_extract_string(e, '$')
    WHEN 'OBJECT' THEN CASE WHEN json_exists(e, '$.url') THEN json_extract_string(e, '$.url')
                            ELSE coalesce(json_extract_string(e, '$.link'), '') END END AS url,
  CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.title') END AS title,
  true AS success, CAST(NULL AS VARCHAR) AS error
FROM el
UNION ALL
SELECT course_id, ord, NULL, NULL, NULL, arr IS NOT NULL, CASE WHEN arr IS NULL THEN 'no list of links' END
FROM arrs WHERE arr IS NULL OR json_array_length(arr) = 0"""

ORACLE["normalize_scrape_payload"] = with_(["links", "scrape_payloads"], """
sp AS (SELECT course_id, ord, url, CASE WHEN json_valid(payload) THEN payload END AS payload FROM scrape_payloads)
""") + """
SELECT course_id, ord, url, coalesce(json_extract_string(payload, '$.markdown'), '') AS markdown,
  CASE WHEN coalesce(json_extract_string(payload, '$.metadata.title'), '') <> ''
       THEN json_extract_string(payload, '$.metadata.title') ELSE json_extract_string(payload, '$.title') END AS title,
  url AS source_url, json_extract_string(payload, '$.metadata.title') AS meta_title,
  CAST(coalesce(len(list_filter(json_keys(payload, '$.metadata'), lambda k: k <> 'source_url')), 0) + 1 AS BIGINT) AS n_meta,
  coalesce(json_type(payload) = 'OBJECT', false) AS success
FROM sp"""

ORACLE["normalize_crawl_payload"] = with_(["links", "crawl_payloads"], """
its AS (SELECT course_id, ord, CASE WHEN starts_with(ltrim(payload), '[') THEN json(payload)
                                    ELSE json_extract(payload, '$.data') END AS arr FROM crawl_payloads),
it AS (SELECT course_id, ord, i - 1 AS pos, json_extract(arr, '$[' || CAST(i - 1 AS VARCHAR) || ']') AS e
       FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(arr) AS BIGINT))) AS i FROM its) x)
""") + """
SELECT course_id, ord, CAST(pos AS BIGINT) AS pos,
  CASE WHEN json_exists(e, '$.metadata.url') THEN json_extract_string(e, '$.metadata.url')
       ELSE coalesce(json_extract_string(e, '$.url'), '') END AS url,
  coalesce(json_extract_string(e, '$.markdown'), '') AS markdown,
  json_extract_string(e, '$.metadata.title') AS title,
  true AS success, CAST(NULL AS VARCHAR) AS error
FROM it
UNION ALL
SELECT course_id, ord, NULL, '', '', NULL, arr IS NOT NULL, CASE WHEN arr IS NULL THEN 'no list of pages' END
FROM its WHERE arr IS NULL OR json_array_length(arr) = 0"""

FP = "fp AS (SELECT *, sha256(markdown) AS content_hash, substring(md5(url), 1, 12) AS file_key FROM content)"
ORACLE["content_fingerprint"] = with_(["content"], FP) + "SELECT page_id, url, content_hash, file_key FROM fp"
ORACLE["cache_split"] = with_(["content"], FP) + """
SELECT course_id, page_id, url, url IN (SELECT url FROM fp WHERE page_id % 2 = 0) AS hit FROM fp WHERE page_id % 2 <> 0"""
ORACLE["drop_known_content"] = with_(["content"], FP) + """
SELECT page_id, url, content_hash FROM fp n WHERE page_id % 2 <> 0 AND NOT EXISTS
  (SELECT 1 FROM fp k WHERE k.page_id % 2 = 0 AND k.url = n.url AND k.content_hash = n.content_hash)"""
ORACLE["latest_scrape"] = with_(["content"], FP) + """
SELECT url, page_id, course_id, retrieved_at, content_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY retrieved_at DESC, page_id DESC) AS rn FROM fp) t WHERE rn = 1"""
ORACLE["upsert_content"] = with_(["content"], FP) + """
SELECT url, content_hash, page_id, course_id, retrieved_at FROM (
  SELECT *, row_number() OVER (PARTITION BY url, content_hash
                               ORDER BY (page_id % 2 <> 0) DESC, retrieved_at DESC, page_id DESC) AS rn FROM fp) t
WHERE rn = 1"""
ORACLE["content_timeline"] = with_(["content"]) + "SELECT course_id, retrieved_at, page_id, url FROM content"

# ---------------------------------------------------------------- state
JOBS = """
js AS (SELECT job_id, course_id,
          count(*) FILTER (WHERE event = 'discovered') AS pages_discovered,
          count(*) FILTER (WHERE event = 'scraped') AS pages_scraped,
          count(*) FILTER (WHERE event = 'failed') AS pages_failed,
          count(*) FILTER (WHERE event = 'processed') AS pages_processed,
          count(*) FILTER (WHERE event = 'generated') AS files_generated,
          min(ts) AS started_at, max(ts) AS completed_at
       FROM job_events GROUP BY job_id, course_id),
jobs AS (SELECT *,
          CASE WHEN pages_discovered = 0 THEN 'failed' WHEN pages_scraped > 0 THEN 'complete' ELSE 'failed' END
            AS current_stage,
          CASE WHEN pages_discovered = 0 THEN 'No pages found for the given IDs'
               WHEN pages_failed > 0 THEN CAST(pages_failed AS VARCHAR) || ' pages failed' END AS error
       FROM js)
"""
ORACLE["job_summary"] = with_(["job_events"], JOBS) + "SELECT * FROM jobs"
ORACLE["running_progress"] = with_(["job_events"]) + """
SELECT job_id, course_id, event_id, ts, event,
  CAST(row_number() OVER w - 1 AS BIGINT) AS seq,
  CAST(sum(CASE WHEN event = 'scraped' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS scraped,
  CAST(sum(CASE WHEN event = 'failed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failed,
  CAST(sum(CASE WHEN event = 'processed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS processed
FROM job_events
WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
ORACLE["latest_job"] = with_(["job_events"], JOBS) + """
SELECT course_id, job_id, started_at, current_stage FROM (
  SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY started_at DESC, job_id DESC) AS rn FROM jobs) t
WHERE rn = 1"""
_stages = ", ".join(f"'{s}'" for s in rules.PIPELINE_STAGES)
ORACLE["progress_ratio"] = with_(["job_events"], JOBS) + f"""
SELECT job_id, course_id,
  CASE WHEN pages_discovered > 0 THEN CAST(pages_scraped AS DOUBLE) / CAST(pages_discovered AS DOUBLE) END
    AS scraped_ratio,
  CAST(coalesce(list_position([{_stages}], current_stage), 0) - 1 AS BIGINT) AS stage_position
FROM jobs"""
ORACLE["course_status"] = with_(["job_events"]) + """
SELECT course_id,
  arg_max(CASE event WHEN 'discovered' THEN 'discovered' WHEN 'scraped' THEN 'ingested' WHEN 'failed' THEN 'failed'
                     WHEN 'processed' THEN 'processed' ELSE 'exported' END, (ts, event_id)) AS status,
  max(ts) AS updated_at,
  max(ts) FILTER (WHERE event IN ('scraped', 'failed')) AS last_synced_at
FROM job_events GROUP BY course_id"""
ORACLE["apply_job_patches"] = with_(["job_events"], JOBS, """
st AS (SELECT job_id, arg_max(CASE event WHEN 'discovered' THEN 'scraping' WHEN 'processed' THEN 'processing'
                                      ELSE 'complete' END, (ts, event_id)) AS v
       FROM job_events WHERE event IN ('discovered', 'processed', 'generated') GROUP BY job_id),
sc AS (SELECT job_id, arg_max(event_id % 100, (ts, event_id)) AS v FROM job_events WHERE event = 'scraped' GROUP BY job_id),
er AS (SELECT job_id, arg_max({'v': CASE WHEN event = 'failed' THEN 'event ' || CAST(event_id AS VARCHAR) END},
                              (ts, event_id)).v AS v
       FROM job_events WHERE event IN ('failed', 'processed') GROUP BY job_id),
fg AS (SELECT job_id, arg_max(event_id % 7, (ts, event_id)) AS v FROM job_events WHERE event = 'generated' GROUP BY job_id)
""") + """
SELECT j.job_id, j.course_id,
  coalesce(st.v, j.current_stage) AS current_stage,
  CAST(coalesce(sc.v, j.pages_scraped) AS BIGINT) AS pages_scraped,
  CASE WHEN er.job_id IS NOT NULL THEN er.v ELSE j.error END AS error,
  CAST(coalesce(fg.v, j.files_generated) AS BIGINT) AS files_generated
FROM jobs j LEFT JOIN st USING (job_id) LEFT JOIN sc USING (job_id) LEFT JOIN er USING (job_id)
LEFT JOIN fg USING (job_id)"""

ORACLE["upsert_pages"] = with_(HW, FRONTIER) + """
SELECT course_id, page_id, url, canonical, CASE WHEN page_id % 5 = 0 THEN title || ' (rev)' ELSE title END AS title,
       content_type, CASE WHEN page_id % 5 = 0 THEN 'scraped' ELSE 'discovered' END AS status
FROM dpages"""
ORACLE["replace_modules"] = with_(HW, FRONTIER, HIER) + """
SELECT course_id, module_id, module_title, order_index FROM hmods
WHERE CAST(substring(course_id, 2) AS BIGINT) % 2 <> 0
UNION ALL
SELECT course_id, course_id || '/replaced', 'Replaced', CAST(0 AS BIGINT) FROM courses
WHERE CAST(substring(course_id, 2) AS BIGINT) % 2 = 0"""
ORACLE["delete_courses"] = with_(HW + ["page_content"], FRONTIER) + """
SELECT page_id, url FROM page_content
WHERE page_id NOT IN (SELECT page_id FROM dpages WHERE CAST(substring(course_id, 2) AS BIGINT) % 4 = 1)"""
ORACLE["toggle_pages"] = with_(HW + ["selection"], FRONTIER, """
ids AS (SELECT course_id, page_id FROM dpages WHERE page_id % 5 = 0)
""") + """
(SELECT course_id, page_id FROM selection EXCEPT ALL SELECT course_id, page_id FROM ids)
UNION ALL
(SELECT course_id, page_id FROM ids EXCEPT ALL SELECT course_id, page_id FROM selection)"""
ORACLE["toggle_modules"] = with_(HW + ["selection"], FRONTIER, HIER, """
tm AS (SELECT a.course_id, a.module_id, a.page_id FROM hassigned a JOIN hmods m
       ON a.course_id = m.course_id AND a.module_id = m.module_id WHERE m.order_index = 0),
mstate AS (SELECT course_id, module_id,
             bool_and(EXISTS (SELECT 1 FROM selection s WHERE s.course_id = tm.course_id AND s.page_id = tm.page_id))
               AS all_sel
           FROM tm GROUP BY course_id, module_id)
""") + """
SELECT DISTINCT course_id, page_id FROM (
  SELECT s.course_id, s.page_id FROM selection s WHERE NOT EXISTS (
    SELECT 1 FROM tm JOIN mstate USING (course_id, module_id)
    WHERE mstate.all_sel AND tm.course_id = s.course_id AND tm.page_id = s.page_id)
  UNION ALL
  SELECT tm.course_id, tm.page_id FROM tm JOIN mstate USING (course_id, module_id) WHERE NOT mstate.all_sel) t"""
ORACLE["all_pages"] = with_(HW, FRONTIER, HIER) + """
SELECT course_id, page_id FROM hassigned UNION SELECT course_id, page_id FROM huncl"""
ORACLE["select_pages"] = with_(HW + ["selection"], FRONTIER) + """
SELECT * FROM dpages WHERE page_id IN (SELECT page_id FROM selection)"""
ORACLE["list_courses"] = with_(["courses"]) + "SELECT * FROM courses"
ORACLE["list_courses_total"] = with_(["courses"]) + "SELECT count(*) AS total FROM courses"
ORACLE["delete_courses_pages"] = with_(HW, FRONTIER) + """
SELECT course_id, page_id, url FROM dpages WHERE CAST(substring(course_id, 2) AS BIGINT) % 4 <> 1"""
ORACLE["replace_modules_pages"] = with_(HW, FRONTIER, HIER) + """
SELECT course_id, page_id, CASE WHEN CAST(substring(course_id, 2) AS BIGINT) % 2 <> 0 THEN module_id END AS module_id
FROM stored"""
_elig = " UNION ALL ".join(
    f"SELECT course_id, '{a}' AS action FROM courses WHERE status IN ({', '.join(repr(s) for s in v)})"
    for a, v in rules.ELIGIBLE_STATUSES.items())
ORACLE["eligible_courses"] = with_(["courses"]) + _elig
ORACLE["validate_courses"] = with_(["links"]) + f"""
SELECT course_id, ord, reason IS NULL AS valid, reason FROM (
  SELECT course_id, ord,
    CASE WHEN title IS NULL OR length(title) < 1 THEN 'name too short'
         WHEN length(title) > 500 THEN 'name too long'
         WHEN url IS NULL OR length(url) < 1 THEN 'url empty'
         WHEN NOT (starts_with({d.strip('url')}, 'http://') OR starts_with({d.strip('url')}, 'https://'))
           THEN 'url must start with http:// or https://' END AS reason
  FROM links) t"""
ORACLE["filter_content_type"] = with_(HW, FRONTIER) + """
SELECT course_id, page_id, content_type,
       CASE WHEN content_type = 'quiz' THEN 'quiz' ELSE 'assignment' END AS bucket
FROM dpages WHERE content_type IN ('quiz', 'assignment', 'project')"""

# ---------------------------------------------------------------- structuring
from sitelore.operators import structure as _st  # noqa: E402


def _enrich(content: str) -> str:
    return f"""
SELECT c.page_id, c.course_id, co.name AS course_name, coalesce(m.module_title, 'Unknown Module') AS module_name,
       CASE WHEN p.page_id IS NOT NULL THEN p.title ELSE 'Unknown' END AS title,
       CASE WHEN p.page_id IS NOT NULL THEN p.url ELSE c.url END AS url,
       CASE WHEN p.page_id IS NOT NULL THEN p.content_type ELSE 'other' END AS content_type,
       c.markdown, coalesce(c.markdown, '') <> '' AS ok
FROM {content} c LEFT JOIN stored p ON p.page_id = c.page_id
LEFT JOIN hmods m ON m.module_id = p.module_id
LEFT JOIN courses co ON co.course_id = c.course_id"""


def _extract_json(resp: str) -> str:
    t = d.strip(resp)
    unf = (f"(CASE WHEN starts_with({t}, '```') THEN array_to_string(list_filter(string_split({t}, chr(10)), "
           f"lambda l: NOT starts_with({d.strip('l')}, '```')), chr(10)) ELSE {t} END)")
    start = f"strpos({unf}, '{{')"
    rpos = f"strpos(reverse({unf}), '}}')"
    last = f"(length({unf}) - {rpos} + 1)"
    span = f"substring({unf}, {start}, {last} - {start} + 1)"
    return (f"(CASE WHEN json_valid({unf}) THEN {unf} "
            f"WHEN {start} > 0 AND {rpos} > 0 AND {last} > {start} AND json_valid({span}) THEN {span} END)")


def _parse_cols(j: str) -> str:
    """Flat structured-record view with the same checks and defaults as parse_structured."""
    ctx = {"title": "title", "course": "coalesce(course_name, '')", "module": "coalesce(module_name, '')",
           "summary": "''", "source_url": "coalesce(url, '')"}
    err = [f"WHEN coalesce(json_type({j}), '') <> 'OBJECT' THEN 'not a JSON object'"]
    vals = {}
    for name in _st.STRING_FIELDS:
        tp = f"json_type({j}, '$.{name}')"
        err.append(f"WHEN NOT coalesce(({tp} IS NULL OR {tp} = 'VARCHAR'), false) THEN 'invalid {name}'")
        vals[name] = f"CASE WHEN {tp} IS NULL THEN {ctx[name]} ELSE json_extract_string({j}, '$.{name}') END"
    vals["source_url"] = ctx["source_url"]
    tp = f"json_type({j}, '$.content_type')"
    ctv = f"(CASE WHEN {tp} IS NULL THEN 'other' ELSE json_extract_string({j}, '$.content_type') END)"
    types = ", ".join(d.q(t) for t in rules.CONTENT_TYPES)
    err.append(f"WHEN NOT coalesce((({tp} IS NULL OR {tp} = 'VARCHAR') AND {ctv} IN ({types})), false) "
               f"THEN 'invalid content_type'")
    vals["content_type"] = ctv
    lists = {}
    for name in _st.LIST_FIELDS:
        tp = f"json_type({j}, '$.{name}')"
        allstr = f"coalesce(list_bool_and(list_transform(json_type({j}, '$.{name}[*]'), lambda t: t = 'VARCHAR')), true)"
        err.append(f"WHEN NOT coalesce(({tp} IS NULL OR ({tp} = 'ARRAY' AND {allstr})), false) THEN 'invalid {name}'")
        lists[name] = f"array_to_string(CASE WHEN {tp} IS NULL THEN [] ELSE json_extract_string({j}, '$.{name}[*]') END, '|')"
    tp = f"json_type({j}, '$.definitions')"
    allobj = f"coalesce(list_bool_and(list_transform(json_type({j}, '$.definitions[*]'), lambda t: t = 'OBJECT')), true)"
    err.append(f"WHEN NOT coalesce(({tp} IS NULL OR ({tp} = 'ARRAY' AND {allobj})), false) THEN 'invalid definitions'")
    defs = (f"array_to_string(CASE WHEN {tp} IS NULL THEN [] ELSE list_transform(json_extract({j}, '$.definitions[*]'), "
            f"lambda e: coalesce(json_extract_string(e, '$.term'), '') || '=' || "
            f"coalesce(json_extract_string(e, '$.definition'), '')) END, '|')")
    error = "CASE " + " ".join(err) + " END"
    ok = f"({error}) IS NULL"
    out = [f"{ok} AS ok", f"{error} AS error"]
    for name in ["title", "course", "module", "content_type", "summary", "source_url"]:
        out.append(f"CASE WHEN {ok} THEN {vals[name]} END AS {name}")
    out.append(f"CASE WHEN {ok} THEN {lists['key_concepts']} END AS key_concepts")
    out.append(f"CASE WHEN {ok} THEN {lists['learning_objectives']} END AS objectives")
    out.append(f"CASE WHEN {ok} THEN {lists['quiz_topics']} END AS quiz_topics")
    out.append(f"CASE WHEN {ok} THEN {defs} END AS definitions")
    return ",\n  ".join(out)


def _summary(md: str) -> str:
    flat = f"regexp_replace(coalesce({md}, ''), {d.q(_st.WS_RUN)}, ' ', 'g')"
    return d.strip(f"array_to_string(list_slice(regexp_extract_all({flat}, {d.q(_st.SENTENCE)}, 0), 1, 3), '')")


def _bullets(md: str, heading_re: str) -> str:
    secs = f"string_split_regex(chr(10) || {md}, {d.q(r'\n#{1,6} ')})"
    picked = f"list_filter(({secs})[2:], lambda s: regexp_matches(split_part(s, chr(10), 1), {d.q(heading_re)}))"
    return f"flatten(list_transform({picked}, lambda s: regexp_extract_all(s, {d.q(r'\n[-*] +([^\n]+)')}, 1)))"


def _prompt(task: str) -> str:
    defaults = _st.TEMPLATE_DEFAULTS[task]
    parts = []
    for piece in _st.TEMPLATES[task]:
        if piece == "content":
            parts.append(f"substring(coalesce(markdown, ''), part * {_st.CONTEXT_LIMITS[task]} + 1, {_st.CONTEXT_LIMITS[task]})")
        elif piece in ("title", "url", "course_name", "module_name"):
            parts.append(f"coalesce({piece}, {d.q(defaults.get(piece, ''))})")
        else:
            parts.append(d.q(piece))
    return " || ".join(parts)


STRUCT_FX = HW + ["page_content", "llm_responses"]
ENR = f"enr AS ({_enrich('page_content')})"
RESP_CTX = f"""
rctx AS (SELECT r.page_id, r.course_id, r.response, e.course_name, e.module_name, e.title, e.url
         FROM llm_responses r LEFT JOIN ({_enrich("(SELECT DISTINCT page_id, course_id, NULL AS url, '' AS markdown FROM llm_responses)")}) e
         ON e.page_id = r.page_id),
rjson AS (SELECT *, {_extract_json('response')} AS json_text FROM rctx),
rparsed AS (SELECT page_id, course_id, {_parse_cols('json_text')} FROM rjson)
"""

ORACLE["enrich_context"] = with_(STRUCT_FX, FRONTIER, HIER, ENR) + "SELECT * FROM enr"
ORACLE["build_llm_requests"] = with_(STRUCT_FX, FRONTIER, HIER, ENR) + " UNION ALL ".join(
    f"SELECT page_id, '{t}' AS task, CAST(part AS INT) AS part, {_prompt(t)} AS prompt FROM (SELECT *, "
    f"unnest(generate_series(0, greatest(CAST(ceil(length(markdown) / {_st.CONTEXT_LIMITS[t]}.0) AS INT) - 1, 0))) AS part "
    f"FROM enr WHERE ok) x" for t in ("classify", "structure", "summarize"))
ORACLE["extract_llm_json"] = with_(["llm_responses"]) + f"SELECT page_id, {_extract_json('response')} AS json_text FROM llm_responses"
ORACLE["parse_structured"] = with_(STRUCT_FX, FRONTIER, HIER, RESP_CTX) + """
SELECT page_id, ok, error, title, course, module, content_type, summary, source_url, key_concepts, objectives,
       quiz_topics, definitions FROM rparsed"""
_ct = "CASE WHEN json_type(j, '$.content_type') IS NULL THEN 'other' ELSE json_extract_string(j, '$.content_type') END"
_cf = """CASE WHEN json_type(j, '$.confidence') IS NULL THEN 0.5
     WHEN json_type(j, '$.confidence') = 'BOOLEAN' THEN CASE WHEN json_extract(j, '$.confidence')::BOOLEAN THEN 1.0 ELSE 0.0 END
     WHEN json_type(j, '$.confidence') = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE)
     WHEN json_type(j, '$.confidence') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract(j, '$.confidence') AS DOUBLE)
     END"""
_types = ", ".join(d.q(t) for t in rules.CONTENT_TYPES)
ORACLE["parse_classification"] = with_(["llm_responses"]) + f"""
SELECT page_id,
  CASE WHEN ok THEN ct ELSE 'other' END AS cls_content_type,
  CAST(CASE WHEN ok THEN cf ELSE 0.0 END AS DOUBLE) AS cls_confidence,
  CASE WHEN ok THEN json_extract_string(j, '$.reasoning') ELSE 'Classification failed' END AS cls_reasoning
FROM (SELECT *, coalesce(json_type(j) = 'OBJECT'
        AND (json_type(j, '$.content_type') IS NULL OR json_type(j, '$.content_type') = 'VARCHAR') AND ct IN ({_types})
        AND cf IS NOT NULL
        AND (json_type(j, '$.reasoning') IS NULL OR json_type(j, '$.reasoning') IN ('VARCHAR', 'NULL')), false) AS ok
      FROM (SELECT page_id, j, {_ct} AS ct, {_cf} AS cf FROM
              (SELECT page_id, {_extract_json('response')} AS j FROM llm_responses) a) b) c"""

_md = "coalesce(markdown, '')"
_dre = r"(?m)^\*\*([^*\n]+)\*\*:[ \t]*([^\n]+)$"
_defs = (f"array_to_string(list_transform(generate_series(1, len(regexp_extract_all({_md}, {d.q(_dre)}, 1))), "
         f"lambda i: regexp_extract_all({_md}, {d.q(_dre)}, 1)[i] || '=' || regexp_extract_all({_md}, {d.q(_dre)}, 2)[i]), '|')")
ORACLE["structure_content"] = with_(STRUCT_FX, FRONTIER, HIER, ENR) + f"""
SELECT page_id, ok, CASE WHEN NOT ok THEN 'empty content' END AS error,
  CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN coalesce(course_name, '') END AS course,
  CASE WHEN ok THEN coalesce(module_name, '') END AS module,
  CASE WHEN ok THEN coalesce(content_type, 'other') END AS content_type,
  CASE WHEN ok THEN {_summary('markdown')} END AS summary,
  CASE WHEN ok THEN coalesce(url, '') END AS source_url,
  CASE WHEN ok THEN array_to_string(list_sort(list_distinct(regexp_extract_all({_md}, {d.q(r'\*\*([^*]+)\*\*')}, 1))), '|') END
    AS key_concepts,
  CASE WHEN ok THEN array_to_string({_bullets(_md, _st.SECTION_FIELDS['learning_objectives'])}, '|') END AS objectives,
  CASE WHEN ok THEN array_to_string({_bullets(_md, _st.SECTION_FIELDS['quiz_topics'])}, '|') END AS quiz_topics,
  CASE WHEN ok THEN {_defs} END AS definitions
FROM enr"""
ORACLE["summarize"] = with_(["content"]) + f"SELECT page_id, {_summary('markdown')} AS summary FROM content"
_cls_text = "concat_ws(' ', title, coalesce(markdown, ''))"
CLS = f"""cls AS (SELECT page_id, {rules.duck_classify_sql("''", _cls_text)} AS cls_content_type FROM enr),
cls2 AS (SELECT page_id, cls_content_type,
           CAST(CASE WHEN cls_content_type <> 'other' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS cls_confidence,
           CASE WHEN cls_content_type <> 'other' THEN 'keyword rule' ELSE 'no rule matched' END AS cls_reasoning FROM cls)"""
_EVERY = "enr AS (SELECT page_id, course_id, CAST(NULL AS VARCHAR) AS title, markdown FROM content)"
ORACLE["classify_content"] = with_(["content"], _EVERY, CLS) + "SELECT * FROM cls2"
ORACLE["resolve_ambiguous"] = with_(STRUCT_FX, FRONTIER, HIER, ENR, CLS) + """
SELECT p.course_id, p.page_id,
  CASE WHEN p.content_type = 'other' AND c.page_id IS NOT NULL THEN c.cls_content_type ELSE p.content_type END AS content_type,
  CASE WHEN p.content_type = 'other' AND c.page_id IS NOT NULL THEN 'model' ELSE 'rules' END AS type_source
FROM dpages p LEFT JOIN cls2 c ON c.page_id = p.page_id"""
_VCTX = RESP_CTX.replace("FROM llm_responses r", "FROM structured_versions r").replace(
    "r.page_id, r.course_id, r.response,", "r.page_id, r.course_id, r.version, r.response,").replace(
    "SELECT page_id, course_id, {", "SELECT page_id, course_id, version, {")
_VCTX = _VCTX.replace("rparsed AS (SELECT page_id, course_id,", "rparsed AS (SELECT page_id, course_id, version,")
ORACLE["current_structured"] = with_(STRUCT_FX + ["structured_versions"], FRONTIER, HIER, _VCTX) + """
SELECT page_id, arg_max(course_id, version) AS course_id, CAST(min(version) AS BIGINT) AS pos,
  arg_max(title, version) AS title, arg_max(content_type, version) AS content_type, arg_max(summary, version) AS summary
FROM rparsed WHERE ok GROUP BY page_id"""
ORACLE["processing_summary"] = with_(STRUCT_FX, FRONTIER, HIER, ENR, RESP_CTX) + """
SELECT course_id, CAST(count(*) FILTER (WHERE res) AS BIGINT) AS processed,
  CAST(count(*) FILTER (WHERE NOT res) AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS total,
  CASE WHEN count(*) FILTER (WHERE res) > 0 THEN 'processed' ELSE 'failed' END AS status,
  CASE WHEN count(*) FILTER (WHERE res) = 0 THEN 'All pages failed processing' END AS error
FROM (SELECT e.course_id, e.page_id, e.ok AND coalesce(r.ok, false) AS res
      FROM enr e LEFT JOIN rparsed r ON r.page_id = e.page_id) t GROUP BY course_id"""

# ---------------------------------------------------------------- documents
from sitelore.operators import documents as _docs  # noqa: E402

_TAIL = _docs.TAIL


def _parse_lists(j: str) -> str:
    """ok, title, summary and the raw lists of a structured record (for the documents)."""
    flat = _parse_cols(j)
    error = flat.split(" AS error")[0].split(" AS ok,\n  ", 1)[1]
    ok = f"(({error}) IS NULL)"

    def lst(name: str) -> str:
        tp = f"json_type({j}, '$.{name}')"
        return f"CASE WHEN {tp} IS NULL THEN CAST([] AS VARCHAR[]) ELSE json_extract_string({j}, '$.{name}[*]') END"

    tp = f"json_type({j}, '$.definitions')"
    defs = (f"CASE WHEN {tp} IS NULL THEN [] ELSE list_transform(json_extract({j}, '$.definitions[*]'), "
            f"lambda e: {{'term': json_extract_string(e, '$.term'), 'definition': json_extract_string(e, '$.definition')}}) END")
    title = f"CASE WHEN json_type({j}, '$.title') IS NULL THEN title ELSE json_extract_string({j}, '$.title') END"
    summary = f"CASE WHEN json_type({j}, '$.summary') IS NULL THEN '' ELSE json_extract_string({j}, '$.summary') END"
    return (f"{ok} AS ok, {title} AS s_title, {summary} AS s_summary, {lst('learning_objectives')} AS objectives, "
            f"{lst('key_concepts')} AS concepts, {defs} AS defs, {lst('important_formulas')} AS formulas, "
            f"{lst('quiz_topics')} AS quiz_topics")


DOCS = f"""
num2 AS (SELECT *, printf('module-%02d', idx) AS prefix FROM (
           SELECT course_id, module_id, module_title, order_index,
                  row_number() OVER (PARTITION BY course_id ORDER BY order_index, module_id) AS idx FROM hmods) n),
latest AS (SELECT page_id, arg_max(markdown, (retrieved_at, markdown)) AS markdown, max(retrieved_at) AS retrieved_at
           FROM scraped GROUP BY page_id),
pc AS (SELECT s.*, l.markdown, l.retrieved_at, l.page_id IS NOT NULL AS scraped
       FROM stored s LEFT JOIN latest l ON l.page_id = s.page_id),
mpc AS (SELECT pc.*, n.module_title, n.idx, n.prefix FROM pc JOIN num2 n
        ON n.course_id = pc.course_id AND n.module_id = pc.module_id),
vctx AS (SELECT r.page_id, r.version, r.response, e.course_name, e.module_name, e.title, e.url
         FROM structured_versions r LEFT JOIN ({_enrich("(SELECT DISTINCT page_id, course_id, NULL AS url, '' AS markdown FROM structured_versions)")}) e
         ON e.page_id = r.page_id),
vjson AS (SELECT *, {_extract_json('response')} AS json_text FROM vctx),
vparsed AS (SELECT page_id, version, {_parse_lists('json_text')} FROM vjson),
cur AS (SELECT page_id, CAST(min(version) AS BIGINT) AS pos, arg_max(s_title, version) AS s_title,
          arg_max(s_summary, version) AS s_summary, arg_max(objectives, version) AS objectives,
          arg_max(concepts, version) AS concepts, arg_max(defs, version) AS defs,
          arg_max(formulas, version) AS formulas, arg_max(quiz_topics, version) AS quiz_topics
        FROM vparsed WHERE ok GROUP BY page_id),
cst AS (SELECT cur.*, s.course_id FROM cur JOIN stored s ON s.page_id = cur.page_id),
ms AS (SELECT mpc.course_id, mpc.module_id, mpc.page_id, mpc.prefix, cst.pos, cst.s_title, cst.s_summary,
              cst.objectives, cst.concepts, cst.defs, cst.formulas, cst.quiz_topics
       FROM mpc JOIN cst ON cst.page_id = mpc.page_id)
"""
DOC_FX = HW + ["page_content", "scraped", "llm_responses", "structured_versions"]


def _dl(src: str, filename: str, sec: str, item: str, lines: list[str]) -> str:
    arr = ", ".join(lines)
    return (f"SELECT course_id, filename, sec, item, CAST(i - 1 AS BIGINT) AS ln, arr[i] AS line FROM ("
            f"SELECT course_id, {filename} AS filename, CAST({sec} AS BIGINT) AS sec, CAST({item} AS BIGINT) AS item, "
            f"[{arr}] AS arr, unnest(generate_series(1, {len(lines)})) AS i FROM {src}) x")


def _u(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


_OVER_F = d.q(_docs.OVERVIEW_FILE)
_TOP = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY pos, page_id) AS rank
                              FROM cst WHERE coalesce(s_summary, '') <> '') t WHERE rank <= 5)"""
_ov = _u(
    _dl("(SELECT c.*, (SELECT count(*) FROM num2 n WHERE n.course_id = c.course_id) AS n_modules FROM courses c)",
        _OVER_F, "0", "-1", ["'# ' || name", "''", "'Course URL: ' || url", "'Total Modules: ' || CAST(n_modules AS VARCHAR)",
                             "''", "'---'", "''", "'## Course Structure'", "''"]),
    _dl("num2", _OVER_F, "idx * 100", "-1", ["'### Module ' || CAST(idx AS VARCHAR) || ': ' || module_title", "''"]),
    _dl("mpc", _OVER_F, "idx * 100", "page_id",
        ["'- ' || coalesce(nullif(title, ''), 'Untitled') || ' ' || "
         "CASE WHEN content_type <> 'other' THEN '[' || content_type || ']' ELSE '' END"]),
    _dl("num2", _OVER_F, "idx * 100", str(_TAIL), ["''"]),
    _dl("(SELECT DISTINCT course_id FROM top)", _OVER_F, str(_TAIL), "-1", ["'## Course Summary'", "''"]),
    _dl("top", _OVER_F, str(_TAIL), "rank", ["'**' || s_title || '**: ' || s_summary", "''"]),
)


def _mod_head(suffix: str) -> str:
    f = f"prefix || {d.q(suffix)}"
    return _u(
        _dl("(SELECT n.*, c.name FROM num2 n LEFT JOIN courses c ON c.course_id = n.course_id)", f, "0", "-1",
            ["'# ' || module_title", "''", "'Course: ' || coalesce(name, '')", "''", "'Source URLs:'"]),
        _dl("mpc", f, "1", "page_id", ["'- ' || url"]),
        _dl("num2", f, "2", "-1", ["''", "'---'", "''"]),
    )


_SRC_F = "prefix || '-source.md'"
_src = _u(
    _mod_head("-source.md"),
    _dl("(SELECT * FROM mpc WHERE scraped AND coalesce(markdown, '') <> '')", _SRC_F, "3", "page_id",
        ["'## ' || coalesce(nullif(title, ''), 'Untitled')", "''", "'*Source: ' || url || '*'",
         "'*Type: ' || content_type || '*'", "''", "markdown", "''", "'---'", "''"]),
    _dl("(SELECT * FROM mpc WHERE scraped AND coalesce(markdown, '') = '')", _SRC_F, "3", "page_id",
        ["'## ' || coalesce(nullif(title, ''), 'Untitled')", "''", "'*Source: ' || url || '*'",
         "'*Type: ' || content_type || '*'", "''", "''", "'---'", "''"]),
)

_KN_F = "prefix || '-knowledge.md'"
_has = "EXISTS (SELECT 1 FROM ms WHERE ms.course_id = n.course_id AND ms.module_id = n.module_id)"


def _items(list_col: str, fmt: str, sec: int) -> str:
    """Entries of a per-page list, item = page, ln = list position."""
    return (f"SELECT course_id, {_KN_F} AS filename, CAST({sec} AS BIGINT) AS sec, CAST(page_id AS BIGINT) AS item, "
            f"CAST(i - 1 AS BIGINT) AS ln, {fmt.replace('v', f'{list_col}[i]')} AS line FROM "
            f"(SELECT *, unnest(generate_series(1, len({list_col}))) AS i FROM ms) x")


def _ranked(list_col: str, fmt: str, sec: int) -> str:
    return (f"SELECT course_id, prefix || '-knowledge.md' AS filename, CAST({sec} AS BIGINT) AS sec, "
            f"CAST(rank AS BIGINT) AS item, CAST(0 AS BIGINT) AS ln, {fmt} AS line FROM ("
            f"SELECT course_id, module_id, prefix, value, row_number() OVER (PARTITION BY course_id, module_id ORDER BY value) - 1 AS rank "
            f"FROM (SELECT DISTINCT course_id, module_id, prefix, unnest({list_col}) AS value FROM ms) u) r")


def _sectioned(entries: str, sec: int, heading: list[str]) -> str:
    files = f"(SELECT DISTINCT course_id, filename FROM ({entries}) e)"
    return _u(_dl(files, "filename", str(sec), "-1", heading), f"SELECT * FROM ({entries}) e2",
              _dl(files, "filename", str(sec), str(_TAIL), ["''"]))


_obj = _items("objectives", "'- ' || v", 4).replace("FROM ms) x", "FROM ms) x")
_defs_entries = (f"SELECT course_id, {_KN_F} AS filename, CAST(7 AS BIGINT) AS sec, CAST(page_id AS BIGINT) AS item, "
                 f"CAST(i - 1 AS BIGINT) AS ln, '- **' || defs[i].term || '**: ' || defs[i].definition AS line FROM "
                 f"(SELECT *, unnest(generate_series(1, len(defs))) AS i FROM ms) x "
                 f"WHERE coalesce(defs[i].term, '') <> '' AND coalesce(defs[i].definition, '') <> ''")
_def_files = "(SELECT DISTINCT course_id, prefix || '-knowledge.md' AS filename FROM ms WHERE len(defs) > 0)"
_kn = _u(
    _mod_head("-knowledge.md"),
    _dl(f"(SELECT * FROM num2 n WHERE NOT {_has})", _KN_F, "3", "-1", [d.q(_docs.NO_STRUCTURED)]),
    _dl(f"(SELECT * FROM num2 n WHERE {_has})", _KN_F, "3", "-1", ["'## Overview'", "''"]),
    _dl("(SELECT * FROM ms WHERE coalesce(s_summary, '') <> '')", _KN_F, "3", "page_id", ["s_summary", "''"]),
    _sectioned(_obj, 4, ["'## Learning Objectives'", "''"]),
    _dl("ms", _KN_F, "5", "page_id", ["'## ' || s_title", "''"]),
    f"SELECT course_id, filename, sec, item, ln + 2 AS ln, line FROM ({_dl('(SELECT * FROM ms WHERE coalesce(s_summary, %s) <> %s)' % (chr(39) * 2, chr(39) * 2), _KN_F, '5', 'page_id', ['s_summary', chr(39) * 2])}) p",
    _sectioned(_ranked("concepts", "'- **' || value || '**'", 6), 6, ["'## Key Concepts'", "''"]),
    _dl(_def_files, "filename", "7", "-1", ["'## Definitions'", "''"]),
    _defs_entries,
    _dl(_def_files, "filename", "7", str(_TAIL), ["''"]),
    _sectioned(_items("formulas", "'- ' || v", 8), 8, ["'## Important Formulas'", "''"]),
    _sectioned(_ranked("quiz_topics", "'- ' || value", 9), 9, ["'## Quiz Topics'", "''"]),
    _dl(f"(SELECT * FROM num2 n WHERE {_has})", _KN_F, "10", "-1", ["'## Module Summary'", "''"]),
    _dl("(SELECT * FROM ms WHERE coalesce(s_summary, '') <> '')", _KN_F, "10", "page_id",
        ["'- **' || s_title || '**: ' || s_summary"]),
    _dl(f"(SELECT * FROM num2 n WHERE {_has})", _KN_F, "10", str(_TAIL), ["''"]),
)


def _bank(types: str, fname: str, title: str, default: str, empty: str) -> str:
    f = d.q(fname)
    return _u(
        _dl("courses", f, "0", "-1", [d.q(title), "''", "'---'", "''"]),
        _dl(f"(SELECT DISTINCT course_id, module_id, idx, module_title FROM mpc WHERE content_type IN ({types}))",
            f, "idx * 100", "-1", ["'## ' || module_title", "''"]),
        _dl(f"(SELECT * FROM mpc WHERE content_type IN ({types}) AND scraped AND coalesce(markdown, '') <> '')",
            f, "idx * 100", "page_id",
            [f"'### ' || coalesce(nullif(title, ''), {d.q(default)})", "'*Source: ' || url || '*'", "''", "markdown",
             "''", "'---'", "''"]),
        _dl(f"(SELECT * FROM courses c WHERE NOT EXISTS (SELECT 1 FROM mpc WHERE mpc.course_id = c.course_id "
            f"AND content_type IN ({types})))", f, str(_TAIL), "-1", [d.q(empty)]),
    )


_quiz = _bank("'quiz'", _docs.QUIZ_FILE, "# Quiz Bank", "Quiz", _docs.NO_QUIZ)
_asg = _bank("'assignment', 'project'", _docs.ASSIGNMENTS_FILE, "# Assignments", "Assignment", _docs.NO_ASSIGNMENTS)
GLOSS = """gl0 AS (SELECT course_id, pos, page_id, i AS dpos, coalesce(defs[i].term, '') AS term,
                  coalesce(defs[i].definition, '') AS definition
           FROM (SELECT *, unnest(generate_series(1, len(defs))) AS i FROM cst) x),
gl AS (SELECT course_id, lower(term) AS term_key, term, definition FROM (
         SELECT *, row_number() OVER (PARTITION BY course_id, lower(term) ORDER BY pos, page_id, dpos) AS rn
         FROM gl0 WHERE term <> '') t WHERE rn = 1),
glr AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY term_key) - 1 AS rank FROM gl)"""
_GL_F = d.q(_docs.GLOSSARY_FILE)
_gloss = _u(
    _dl("courses", _GL_F, "0", "-1", ["'# Glossary'", "''", "'---'", "''"]),
    _dl("(SELECT * FROM courses c WHERE NOT EXISTS (SELECT 1 FROM cst WHERE cst.course_id = c.course_id AND len(defs) > 0))",
        _GL_F, "1", "-1", [d.q(_docs.NO_DEFINITIONS)]),
    _dl("glr", _GL_F, "1", "rank", ["'**' || term || '**'", "': ' || definition", "''"]),
)
_SR_F = d.q(_docs.SOURCES_FILE)
_iso = ("strftime(retrieved_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(retrieved_at, '%f') <> '000000' "
        "THEN '.' || strftime(retrieved_at, '%f') ELSE '' END || '+00:00'")
_srcs = _u(
    _dl("courses", _SR_F, "0", "-1", ["'# Sources'", "''", d.q(_docs.SOURCES_INTRO), "''", "'---'", "''"]),
    _dl("num2", _SR_F, "idx * 100", "-1", ["'## ' || module_title", "''"]),
    _dl("mpc", _SR_F, "idx * 100", "page_id",
        [f"'- [' || coalesce(nullif(title, ''), url) || '](' || url || ') — *' || content_type || "
         f"'* — Retrieved: ' || CASE WHEN scraped THEN {_iso} ELSE 'N/A' END"]),
    _dl("num2", _SR_F, "idx * 100", str(_TAIL), ["''"]),
)
_DW = with_(DOC_FX, FRONTIER, HIER, DOCS, _TOP, GLOSS)
ORACLE["doc_course_overview"] = _DW + _ov
ORACLE["doc_source_layer"] = _DW + _src
ORACLE["doc_knowledge_layer"] = _DW + _kn
ORACLE["doc_quiz_bank"] = _DW + _quiz
ORACLE["doc_assignments"] = _DW + _asg
ORACLE["doc_glossary"] = _DW + _gloss
ORACLE["doc_sources"] = _DW + _srcs
ORACLE["render_documents"] = _DW + f"""
SELECT course_id, filename, sec, item, string_agg(line, chr(10) ORDER BY ln) AS text FROM (
{_u(_ov, _src, _kn, _quiz, _asg, _gloss, _srcs)}) all_lines GROUP BY course_id, filename, sec, item"""
ORACLE["number_modules"] = _DW + "SELECT course_id, module_id, order_index, idx, prefix FROM num2"
ORACLE["page_content"] = _DW + """
SELECT course_id, page_id, scraped, coalesce(markdown, 'N/A') AS markdown, retrieved_at FROM pc"""
ORACLE["top_summaries"] = _DW + "SELECT course_id, page_id, CAST(rank AS BIGINT) AS rank, s_summary AS summary FROM top"
_mc = """SELECT course_id, module_id, value, CAST(row_number() OVER (PARTITION BY course_id, module_id ORDER BY value) - 1 AS BIGINT) AS rank
FROM (SELECT DISTINCT course_id, module_id, unnest({c}) AS value FROM ms) u"""
ORACLE["module_concepts"] = _DW + _mc.format(c="concepts")
ORACLE["module_quiz_topics"] = _DW + _mc.format(c="quiz_topics")
ORACLE["module_collections"] = _DW + """
SELECT course_id, module_id, 'objective' AS kind, page_id, CAST(i - 1 AS BIGINT) AS pos, objectives[i] AS value
FROM (SELECT *, unnest(generate_series(1, len(objectives))) AS i FROM ms) a
UNION ALL
SELECT course_id, module_id, 'definition', page_id, CAST(i - 1 AS BIGINT), '- **' || defs[i].term || '**: ' || defs[i].definition
FROM (SELECT *, unnest(generate_series(1, len(defs))) AS i FROM ms) b
WHERE coalesce(defs[i].term, '') <> '' AND coalesce(defs[i].definition, '') <> ''
UNION ALL
SELECT course_id, module_id, 'formula', page_id, CAST(i - 1 AS BIGINT), formulas[i]
FROM (SELECT *, unnest(generate_series(1, len(formulas))) AS i FROM ms) c
UNION ALL
SELECT course_id, module_id, 'summary', page_id, CAST(0 AS BIGINT), s_summary FROM ms WHERE coalesce(s_summary, '') <> ''"""
ORACLE["glossary"] = _DW + "SELECT course_id, term_key, term, definition FROM gl"
_MAN = f"""man AS (
  SELECT course_id, CAST(0 AS BIGINT) AS seq, {_OVER_F} AS filename FROM courses
  UNION ALL SELECT course_id, idx * 2 - 1, prefix || '-source.md' FROM num2
  UNION ALL SELECT course_id, idx * 2, prefix || '-knowledge.md' FROM num2
  UNION ALL SELECT course_id, {_TAIL} + 1, {d.q(_docs.QUIZ_FILE)} FROM courses
  UNION ALL SELECT course_id, {_TAIL} + 2, {d.q(_docs.ASSIGNMENTS_FILE)} FROM courses
  UNION ALL SELECT course_id, {_TAIL} + 3, {d.q(_docs.GLOSSARY_FILE)} FROM courses
  UNION ALL SELECT course_id, {_TAIL} + 4, {d.q(_docs.SOURCES_FILE)} FROM courses)"""
_ftype = "CASE " + " ".join(f"WHEN contains(filename, {d.q(n)}) THEN {d.q(t)}" for n, t in rules.EXPORT_FILE_TYPES) + \
    " ELSE 'other' END"
ORACLE["export_manifest"] = with_(DOC_FX, FRONTIER, HIER, DOCS, _MAN) + f"""
SELECT m.course_id, CAST(m.seq AS BIGINT) AS seq, m.filename, {_ftype} AS file_type,
  CAST(5 + 2 * (SELECT count(*) FROM num2 n WHERE n.course_id = m.course_id) AS BIGINT) AS files_generated
FROM man m"""
ORACLE["export_file_type"] = with_(DOC_FX, FRONTIER, HIER, DOCS, _MAN) + f"SELECT course_id, filename, {_ftype} AS file_type FROM man"

# ---------------------------------------------------------------- sinks and streaming
_raw = with_(["content"]) + """
SELECT course_id, page_id, CAST(page_id AS VARCHAR) || '.md' AS filename,
       CAST(strlen(coalesce(markdown, '')) AS BIGINT) AS size_bytes, url, sha256(markdown) AS content_hash FROM content"""
ORACLE["write_raw"] = with_(["content"], FP) + """
SELECT course_id, page_id, file_key, sha256(coalesce(markdown, '')) AS text_sha256 FROM fp"""
ORACLE["read_raw"] = _raw
ORACLE["write_processed"] = _DW + "SELECT course_id, page_id, s_title AS title, s_summary AS summary FROM cst"
_exp = _DW + f"""
SELECT course_id, filename, CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes, {_ftype} AS file_type,
       round(sum(strlen(text) + 1) / 1024.0, 1) AS size_kb
FROM (SELECT course_id, filename, sec, item, string_agg(line, chr(10) ORDER BY ln) AS text FROM (
{_u(_ov, _src, _kn, _quiz, _asg, _gloss, _srcs)}) all_lines GROUP BY course_id, filename, sec, item) b
GROUP BY course_id, filename"""
ORACLE["write_exports"] = _DW + f"""
SELECT course_id, filename, CAST(sum(1 + len(line) - len(replace(line, chr(10), ''))) AS BIGINT) AS n_lines
FROM ({_u(_ov, _src, _kn, _quiz, _asg, _gloss, _srcs)}) all_lines GROUP BY course_id, filename"""
ORACLE["list_exports"] = _exp
ORACLE["stream_ingest"] = with_(["content"]) + "SELECT DISTINCT url, sha256(markdown) AS content_hash FROM content WHERE coalesce(markdown, '') <> ''"
ORACLE["stream_ingest_known"] = with_(["content"], FP) + """
SELECT DISTINCT url, content_hash FROM fp n WHERE page_id % 2 <> 0 AND coalesce(markdown, '') <> '' AND NOT EXISTS
  (SELECT 1 FROM fp k WHERE k.page_id % 2 = 0 AND k.url = n.url AND k.content_hash = n.content_hash)"""
ORACLE["stream_discover"] = ORACLE["discover_pages"]
ORACLE["stream_progress"] = with_(["job_events"], JOBS) + """
SELECT job_id, course_id, pages_discovered, pages_scraped, pages_failed, pages_processed, files_generated FROM js"""
ORACLE["humanize_segment"] = with_(HW, FRONTIER) + f"""
SELECT course_id, page_id, segment, {d.humanize('segment')} AS module_title FROM (
  SELECT DISTINCT course_id, page_id, unnest({d.segments('url')}) AS segment FROM dpages) s"""
