"""DuckDB (RE2) renderings of the URL expressions, used only to write the SQL oracle.

They restate the same ``urlparse`` semantics in DuckDB SQL; notably DuckDB's
``regexp_replace`` needs the ``'g'`` flag to replace every match like Spark does.
"""

from __future__ import annotations

from sitelore.functions import urls


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RE = q(urls.URL_SPLIT_RE)
PARAM_SCHEMES = ", ".join(q(s) for s in urls.PARAM_SCHEMES)
WS = urls.PY_WS_CLASS


def strip(u: str) -> str:
    return f"regexp_replace({u}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def prep(u: str) -> str:
    return f"regexp_replace(regexp_replace({u}, {q(r'^[\x{00}-\x{20}]+')}, ''), {q(r'[\t\r\n]')}, '', 'g')"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({prep(u)}, {RE}, 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({prep(u)}, {RE}, 2)"


def raw_path(u: str) -> str:
    return f"regexp_extract({prep(u)}, {RE}, 3)"


def path(u: str) -> str:
    return (f"(CASE WHEN {scheme(u)} IN ({PARAM_SCHEMES}) THEN regexp_replace({raw_path(u)}, ';[^/]*$', '') "
            f"ELSE {raw_path(u)} END)")


def params(u: str) -> str:
    return (f"(CASE WHEN {scheme(u)} IN ({PARAM_SCHEMES}) THEN regexp_extract({raw_path(u)}, ';([^/]*)$', 1) "
            f"ELSE '' END)")


def query(u: str) -> str:
    return f"regexp_extract({prep(u)}, {RE}, 4)"


def fragment(u: str) -> str:
    return f"regexp_extract({prep(u)}, {RE}, 5)"


def hostname(u: str) -> str:
    hi = f"regexp_replace({netloc(u)}, '^.*@', '')"
    return (f"lower(CASE WHEN instr({hi}, '[') > 0 THEN regexp_extract({hi}, {q(r'\[([^\]]*)')}, 1) "
            f"ELSE regexp_extract({hi}, '^([^:]*)', 1) END)")


def base_domain(u: str) -> str:
    n = netloc(u)
    return (f"(CASE WHEN (instr({n}, '[') > 0) <> (instr({n}, ']') > 0) THEN '' "
            f"ELSE regexp_replace({hostname(u)}, {q(r'^www\.')}, '') END)")


def canonical(u: str) -> str:
    return (f"lower({scheme(u)} || '://' || {netloc(u)} || regexp_replace({path(u)}, '/+$', '') || "
            f"CASE WHEN {query(u)} <> '' THEN '?' || {query(u)} ELSE '' END)")


def py_title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, {q(r'([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)')}, 1), "
            f"lambda w: upper(left(w, 1)) || lower(substring(w, 2))), '')")


def title_from_url(u: str) -> str:
    stripped = f"regexp_replace({path(u)}, '^/+|/+$', '', 'g')"
    seg = f"list_element(string_split({stripped}, '/'), -1)"
    seg = f"regexp_replace({seg}, {q(r'\.[^.]*$')}, '')"
    seg = f"regexp_replace({seg}, '[-_]+', ' ', 'g')"
    return f"(CASE WHEN {stripped} = '' THEN 'Home' ELSE {py_title(seg)} END)"


def humanize(x: str) -> str:
    seg = f"regexp_replace({x}, '(?i)^(module|unit|week|topic|section)[-_]?', '')"
    seg = f"regexp_replace({seg}, '[-_]+', ' ', 'g')"
    core = strip(seg)
    return (f"(CASE WHEN regexp_matches({core}, {q(r'^\p{Nd}+$')}) THEN 'Module ' || {core} "
            f"WHEN {core} = '' THEN 'Unnamed Module' ELSE {py_title(core)} END)")


def segments(u: str) -> str:
    return f"list_filter(string_split(regexp_replace({path(u)}, '^/+|/+$', '', 'g'), '/'), lambda s: s <> '')"
