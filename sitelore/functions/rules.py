"""Classification and relevance rules kept as data, compiled into single native expressions.

The rule lists below are fixed values that must equal the reference's for identical results.
Each list is compiled once into a ``CASE WHEN ... rlike`` chain (first match wins, list order)
or a single alternation, so a URL is classified in one pass inside whole-stage codegen.
Patterns are written so that Java regex (Spark) and RE2 (the DuckDB oracle) read them alike:
no look-around, Unicode classes spelled out instead of ``\\b``/``\\d``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelore.functions import urls

# ---------------------------------------------------------------- fixed values
CONTENT_TYPES = [
    "course_overview", "module", "lecture", "reading", "quiz", "assignment",
    "project", "announcement", "reference", "pdf", "video", "other",
]
COURSE_STATUSES = [
    "created", "discovering", "discovered", "ingesting", "ingested",
    "processing", "processed", "exporting", "exported", "failed",
]
JOB_STAGES = ["mapping", "discovering", "scraping", "processing", "exporting", "complete", "failed"]
PAGE_STATUSES = ["discovered", "selected", "scraping", "scraped", "processing", "processed", "failed", "skipped"]

# File-type checks on the lower-cased path, before the path rules.
FILE_RULES = [
    (r"\.(pdf)$", "pdf"),
    (r"\.(docx?|pptx?|xlsx?|csv)$", "reference"),
]

# Path rules (case-insensitive search in the lower-cased path), first match wins.
PATH_RULES = [
    (r"/quiz", "quiz"),
    (r"/exam", "quiz"),
    (r"/test[/-]", "quiz"),
    (r"/assignment", "assignment"),
    (r"/homework", "assignment"),
    (r"/hw[/-]", "assignment"),
    (r"/project", "project"),
    (r"/lab[/-]", "project"),
    (r"/lecture", "lecture"),
    (r"/lesson", "lecture"),
    (r"/slide", "lecture"),
    (r"/reading", "reading"),
    (r"/textbook", "reading"),
    (r"/chapter", "reading"),
    (r"/module", "module"),
    (r"/unit[/-]", "module"),
    (r"/week[/-]", "module"),
    (r"/topic[/-]", "module"),
    (r"/syllabus", "course_overview"),
    (r"/overview", "course_overview"),
    (r"/course[-_]?info", "course_overview"),
    (r"/announcement", "announcement"),
    (r"/news", "announcement"),
    (r"/video", "video"),
    (r"/media", "video"),
    (r"/reference", "reference"),
    (r"/resource", "reference"),
    (r"/bibliography", "reference"),
]

# Title keyword rules (case-insensitive, Unicode word boundaries), first match wins.
# Written with explicit word-boundary groups: W = [^\p{L}\p{N}_].
_B = r"(^|[^\p{L}\p{N}_])"
_E = r"($|[^\p{L}\p{N}_])"
TITLE_RULES = [
    (_B + r"quiz" + _E, "quiz"),
    (_B + r"exam" + _E, "quiz"),
    (_B + r"midterm" + _E, "quiz"),
    (_B + r"final\s+exam" + _E, "quiz"),
    (_B + r"assignment" + _E, "assignment"),
    (_B + r"homework" + _E, "assignment"),
    (_B + r"project" + _E, "project"),
    (_B + r"lab" + _E, "project"),
    (_B + r"lecture" + _E, "lecture"),
    (_B + r"lesson" + _E, "lecture"),
    (_B + r"reading" + _E, "reading"),
    (_B + r"chapter" + _E, "reading"),
    (_B + r"module" + _E, "module"),
    (_B + r"unit\s+\p{Nd}", "module"),
    (_B + r"week\s+\p{Nd}", "module"),
    (_B + r"syllabus" + _E, "course_overview"),
    (_B + r"course\s+overview" + _E, "course_overview"),
    (_B + r"announcement", "announcement"),
]

# Deny rules, searched in the whole URL (not only the path), case-insensitive.
DENY_RULES = [
    r"/login",
    r"/logout",
    r"/sign[-_]?in",
    r"/sign[-_]?up",
    r"/register",
    r"/password",
    r"/auth",
    r"/oauth",
    r"/sso",
    r"/admin",
    r"/settings",
    r"/profile",
    r"/account",
    r"/cart",
    r"/checkout",
    r"/privacy",
    r"/terms",
    r"/cookie",
    r"/sitemap\.xml",
    r"/robots\.txt",
    r"/favicon",
    r"\.(css|js|woff|woff2|ttf|eot|svg|ico)$",
    r"#",
    r"^mailto:",
    r"^tel:",
    r"^javascript:",
]

# Export file type: first substring hit in this order (the 'sources' branch is unreachable).
EXPORT_FILE_TYPES = [
    ("source", "source"),
    ("knowledge", "knowledge"),
    ("overview", "overview"),
    ("quiz", "quiz"),
    ("glossary", "glossary"),
    ("sources", "sources"),
    ("assignment", "assignment"),
]

# Course statuses at which a UI action is offered.
ELIGIBLE_STATUSES = {
    "open": ["discovered", "ingested", "processed", "exported", "failed"],
    "process": ["ingested", "processed", "exported", "failed"],
    "export": ["processed", "exported"],
}

# Job pipeline order used for progress position; 'failed' is -1.
PIPELINE_STAGES = ["mapping", "discovering", "scraping", "processing", "exporting", "complete"]
# ---------------------------------------------------------------- end of fixed values

CI = "(?iu)"  # Java: case-insensitive with Unicode case folding


def deny_pattern() -> str:
    """All deny rules as one grouped alternation."""
    return "|".join(f"(?:{p})" for p in DENY_RULES)


def deny_pattern_lower() -> str:
    """The deny rules for an already lower-cased URL: the rules that start with '/' share one
    '/' so the regex tests a single character at most positions (rules are lower-case ASCII,
    so matching the lower-cased URL case-sensitively equals the case-insensitive rules)."""
    slash = [p[1:] for p in DENY_RULES if p.startswith("/")]
    other = [p for p in DENY_RULES if not p.startswith("/")]
    return "|".join([f"/(?:{'|'.join(slash)})"] + [f"(?:{p})" for p in other])


def _raw(s: str) -> str:
    """Spark SQL raw string literal (no escape processing; patterns contain no quote)."""
    assert "'" not in s
    return "r'" + s + "'"


def classify_sql(path_sql: str, title_sql: str) -> str:
    """The rule chain as one Spark SQL ``CASE`` text (built once, parsed in one call)."""
    # rules are lower-case ASCII: matching lower-cased text case-sensitively is the same test
    lp, lt = f"lower({path_sql})", f"lower({title_sql})"
    parts = ["CASE"]
    for pattern, ctype in FILE_RULES + PATH_RULES:
        parts.append(f" WHEN {lp} RLIKE {_raw(pattern)} THEN '{ctype}'")
    for pattern, ctype in TITLE_RULES:
        parts.append(f" WHEN coalesce({title_sql}, '') <> '' AND {lt} RLIKE {_raw(pattern)} THEN '{ctype}'")
    parts.append(" ELSE 'other' END")
    return "".join(parts)


def is_denied(url: Column) -> Column:
    return F.lower(url).rlike(deny_pattern_lower())


def is_relevant(url: Column, course_base: Column, url_base: Column | None = None) -> Column:
    """http(s) prefix (case-sensitive), no deny rule in the whole URL, same host (empty base accepts all).

    ``url_base`` is the URL's base domain if already derived from a parts column."""
    scheme_ok = url.startswith("http://") | url.startswith("https://")
    url_base = urls.base_domain(url) if url_base is None else url_base
    same_host = (course_base == "") | (url_base == course_base)
    return F.coalesce(scheme_ok & ~is_denied(url) & same_host, F.lit(False))


def classify_content_type(url: Column, title: Column, path: Column | None = None) -> Column:
    """File types, then path rules, then title rules (only for a non-empty title), else 'other'.

    ``path`` is the urlparse path if already derived from a parts column."""
    path = F.lower(urls.url_path(url) if path is None else path)
    expr = None
    for pattern, ctype in FILE_RULES + PATH_RULES:
        cond = path.rlike(CI + pattern)
        expr = F.when(cond, F.lit(ctype)) if expr is None else expr.when(cond, F.lit(ctype))
    has_title = title.isNotNull() & (title != "")
    for pattern, ctype in TITLE_RULES:
        expr = expr.when(has_title & title.rlike(CI + pattern), F.lit(ctype))
    return expr.otherwise(F.lit("other"))


def export_file_type(name: Column) -> Column:
    expr = None
    for needle, ftype in EXPORT_FILE_TYPES:
        cond = F.instr(name, needle) > 0
        expr = F.when(cond, F.lit(ftype)) if expr is None else expr.when(cond, F.lit(ftype))
    return expr.otherwise(F.lit("other"))


def is_valid_content_type(col: Column) -> Column:
    return col.isin(CONTENT_TYPES)


# ---- DuckDB (RE2) renderings of the same rule tables, used by the SQL oracle only.

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duck_classify_sql(path_lower: str, title: str) -> str:
    parts = ["CASE"]
    for pattern, ctype in FILE_RULES + PATH_RULES:
        parts.append(f" WHEN regexp_matches({path_lower}, {_sql_str('(?i)' + pattern)}) THEN {_sql_str(ctype)}")
    for pattern, ctype in TITLE_RULES:
        parts.append(f" WHEN coalesce({title}, '') <> '' AND regexp_matches({title}, {_sql_str('(?i)' + pattern)})"
                     f" THEN {_sql_str(ctype)}")
    parts.append(" ELSE 'other' END")
    return "".join(parts)


def duck_deny_sql(url: str) -> str:
    return f"regexp_matches({url}, {_sql_str('(?i)' + deny_pattern())})"
