"""URL column expressions with Python ``urllib.parse`` semantics, built from native functions.

All functions take and return ``Column`` objects, so they stay inside whole-stage codegen.
``parse_url`` is deliberately not used: it raises (ANSI) or returns NULL on URLs that
``urlparse`` splits leniently (e.g. a space in the path).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelore.functions.exprs import let

# Fixed values (RFC 3986 appendix B split, scheme restricted to what urlsplit accepts).
URL_SPLIT_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Characters Python's str.strip() removes (str.isspace), written so Java and RE2 both accept it.
PY_WS_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Schemes for which urlparse splits ';params' off the last path segment (fixed values).
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
                 "rtspu", "sip", "sips", "mms", "sftp", "tel"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
               + "\u2028\u2029\u202f\u205f\u3000")
C0_AND_SPACE = "".join(chr(c) for c in range(0x00, 0x21))


def py_strip(col: Column | str) -> Column:
    """Python ``str.strip()``: ``trim`` with the set of characters ``str.isspace`` accepts
    (plain ``trim`` only removes spaces)."""
    return F.trim(_c(col), F.lit(PY_WS_CHARS))


def _prepared(col: Column | str) -> Column:
    # urlsplit drops leading C0 controls/space and removes tab/CR/LF anywhere.
    return F.translate(F.ltrim(_c(col), F.lit(C0_AND_SPACE)), "\t\r\n", "")


def _first_of(s: Column, chars: str) -> Column:
    """1-based position of the first of ``chars`` in ``s``; ``length(s) + 1`` when none occurs."""
    big = F.length(s) + 1
    pos = [F.when(F.instr(s, ch) > 0, F.instr(s, ch)).otherwise(big) for ch in chars]
    return F.least(*pos)


def url_parts(col: Column | str) -> Column:
    """Struct of the six ``urlparse`` fields plus hostname, as one compact expression (one
    RFC 3986 split regex per field). For big tables prefer :func:`with_url_parts`, which
    computes the split once per row with string functions."""
    prepared = _prepared(col)
    scheme = F.lower(F.regexp_extract(prepared, URL_SPLIT_RE, 1))
    raw_path = F.regexp_extract(prepared, URL_SPLIT_RE, 3)
    netloc = F.regexp_extract(prepared, URL_SPLIT_RE, 2)
    splits_params = scheme.isin(PARAM_SCHEMES)
    return F.struct(
        scheme.alias("scheme"),
        netloc.alias("netloc"),
        _hostname(netloc).alias("hostname"),
        F.when(splits_params, F.regexp_replace(raw_path, r";[^/]*$", "")).otherwise(raw_path).alias("path"),
        F.when(splits_params, F.regexp_extract(raw_path, r";([^/]*)$", 1)).otherwise(F.lit("")).alias("params"),
        F.regexp_extract(prepared, URL_SPLIT_RE, 4).alias("query"),
        F.regexp_extract(prepared, URL_SPLIT_RE, 5).alias("fragment"),
    )


def with_url_parts(df, url_col: str = "url", out: str = "_u"):
    """DataFrame form of :func:`url_parts` for large inputs: every intermediate of the split is
    its own column, so each is computed once per row (the nested Column form re-evaluates shared
    sub-expressions) and the generated code stays small."""
    keep = list(df.columns)
    t = df.withColumn("_up", _prepared(F.col(url_col)))
    ok = F.col("_up").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    colon = F.instr(F.col("_up"), ":")
    t = t.withColumns({
        "_us": F.when(ok, F.lower(F.substring(F.col("_up"), 1, colon - 1))).otherwise(F.lit("")),
        "_ur": F.when(ok, F.substring(F.col("_up"), colon + 1, 1 << 30)).otherwise(F.col("_up")),
    })
    t = t.withColumns({"_un": F.col("_ur").startswith("//")})
    t = t.withColumns({"_ua": F.when(F.col("_un"), F.substring(F.col("_ur"), 3, 1 << 30)).otherwise(F.col("_ur"))})
    t = t.withColumns({"_ue": _first_of(F.col("_ua"), "/?#")})
    t = t.withColumns({
        "_unet": F.when(F.col("_un"), F.substring(F.col("_ua"), 1, F.col("_ue") - 1)).otherwise(F.lit("")),
        "_ut": F.when(F.col("_un"), F.substring(F.col("_ua"), F.col("_ue"), 1 << 30)).otherwise(F.col("_ur")),
    })
    t = t.withColumns({"_uh": F.instr(F.col("_ut"), "#")})
    t = t.withColumns({
        "_ufr": F.when(F.col("_uh") > 0, F.substring(F.col("_ut"), F.col("_uh") + 1, 1 << 30)).otherwise(F.lit("")),
        "_ub": F.when(F.col("_uh") > 0, F.substring(F.col("_ut"), 1, F.col("_uh") - 1)).otherwise(F.col("_ut")),
    })
    t = t.withColumns({"_uq": F.instr(F.col("_ub"), "?")})
    t = t.withColumns({
        "_uqs": F.when(F.col("_uq") > 0, F.substring(F.col("_ub"), F.col("_uq") + 1, 1 << 30)).otherwise(F.lit("")),
        "_urp": F.when(F.col("_uq") > 0, F.substring(F.col("_ub"), 1, F.col("_uq") - 1)).otherwise(F.col("_ub")),
    })
    t = t.withColumns({"_uls": F.substring_index(F.col("_urp"), "/", -1)})
    t = t.withColumns({"_usc": F.instr(F.col("_uls"), ";")})
    splits = F.col("_us").isin(PARAM_SCHEMES) & (F.col("_usc") > 0)
    cut = F.length(F.col("_urp")) - F.length(F.col("_uls")) + F.col("_usc")
    parts = F.struct(
        F.col("_us").alias("scheme"),
        F.col("_unet").alias("netloc"),
        _hostname(F.col("_unet")).alias("hostname"),
        F.when(splits, F.substring(F.col("_urp"), 1, cut - 1)).otherwise(F.col("_urp")).alias("path"),
        F.when(splits, F.substring(F.col("_uls"), F.col("_usc") + 1, 1 << 30)).otherwise(F.lit("")).alias("params"),
        F.col("_uqs").alias("query"),
        F.col("_ufr").alias("fragment"),
    )
    return t.select(*keep, parts.alias(out))


def _hostname(netloc: Column) -> Column:
    """``urlparse(url).hostname or ''``: no user-info, no port, lower case, IPv6 brackets removed."""
    hostinfo = F.substring_index(netloc, "@", -1)
    host = F.when(F.instr(hostinfo, "[") > 0, F.regexp_extract(hostinfo, r"\[([^\]]*)", 1)).otherwise(
        F.substring_index(hostinfo, ":", 1))
    return F.lower(host)


def base_domain_of(parts: Column) -> Column:
    """Host for same-site checks: lower case, one leading ``www.`` removed; invalid IPv6 → ''."""
    netloc = parts["netloc"]
    bad_ipv6 = (F.instr(netloc, "[") > 0) != (F.instr(netloc, "]") > 0)
    return F.when(bad_ipv6, F.lit("")).otherwise(F.regexp_replace(parts["hostname"], r"^www\.", ""))


def canonical_of(parts: Column) -> Column:
    """``scheme://netloc`` + path without trailing '/' + ``?query``; fragment/params dropped; lower."""
    query = parts["query"]
    return F.lower(F.concat(
        parts["scheme"], F.lit("://"), parts["netloc"], F.rtrim(parts["path"], F.lit("/")),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    ))


def title_from_path(path: Column) -> Column:
    """Readable title from the last path segment; empty path → 'Home'."""
    stripped = F.trim(path, F.lit("/"))
    segment = F.substring_index(stripped, "/", -1)
    dot = F.instr(F.reverse(segment), ".")
    segment = F.when(dot > 0, F.substring(segment, 1, F.length(segment) - dot)).otherwise(segment)
    segment = F.regexp_replace(segment, r"[-_]+", " ")
    return F.when(stripped == "", F.lit("Home")).otherwise(py_title(segment))


def segments_of(path: Column) -> Column:
    """Non-empty segments of a urlparse path."""
    return F.filter(F.split(F.trim(path, F.lit("/")), "/"), lambda s: s != "")


# Convenience forms on a raw URL column.
def url_path(col: Column | str) -> Column:
    return url_parts(col)["path"]


def base_domain(col: Column | str) -> Column:
    return base_domain_of(url_parts(col))


def canonical_url(col: Column | str) -> Column:
    return canonical_of(url_parts(col))


def title_from_url(col: Column | str) -> Column:
    return title_from_path(url_path(col))


def path_segments(col: Column | str) -> Column:
    return segments_of(url_path(col))


TITLE_MARK = "\u0000 "
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def py_title(col: Column | str) -> Column:
    """Python ``str.title()``: every cased letter that follows anything else starts a word (so
    ``hw2solutions don't`` → ``Hw2Solutions Don'T`` and ``日本語guide`` → ``日本語Guide``, unlike ``initcap``). A marker + space is put
    at each such boundary, ``initcap`` (which starts words after spaces) does the casing, and the
    markers are removed again; all native, codegen'd string functions."""
    marked = F.regexp_replace(F.lower(_c(col)), rf"([^{CASED}])([{CASED}])", "$1" + TITLE_MARK + "$2")
    return F.replace(F.initcap(marked), F.lit(TITLE_MARK), F.lit(""))


def humanize_segment(col: Column | str) -> Column:
    """Module title from a path segment (prefix word removed, digits → 'Module N')."""
    seg = F.regexp_replace(_c(col), r"(?i)^(module|unit|week|topic|section)[-_]?", "")
    seg = F.regexp_replace(seg, r"[-_]+", " ")
    core = py_strip(seg)
    return (F.when(core.rlike(r"^\p{Nd}+$"), F.concat(F.lit("Module "), core))
            .when(core == "", F.lit("Unnamed Module"))
            .otherwise(py_title(core)))


def path_prefixes(path_col: Column | str) -> Column:
    """All strings ``p`` such that ``path == p`` or ``path`` starts with ``p + '/'``."""
    parts = F.split(_c(path_col), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


# ---------------------------------------------------------------- references
# fixed value: the five parts of a reference (scheme, authority, path, query, fragment)
REFERENCE_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _reference_parts(ref: Column) -> Column:
    """``scheme`` (null without), ``authority`` with its slashes, ``path``, ``query`` and ``fragment`` with their marks."""
    def part(i: int) -> Column:
        return F.regexp_extract(ref, REFERENCE_RE, i)

    return F.struct(F.nullif(part(1), F.lit("")).alias("scheme"), part(2).alias("authority"), part(3).alias("path"),
                    part(4).alias("query"), part(5).alias("fragment"))


def remove_dot_segments(path: Column) -> Column:
    """``/a/./b/../c`` → ``/a/c``: a fold over the segments of an absolute path; ``..`` never leaves the root."""
    def folded(segments: Column) -> Column:
        kept = F.aggregate(
            F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc).when(
                s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))

    dotted = F.contains(path, F.lit("/."))
    return F.when(path.startswith("/") & dotted, let(F.split(path, "/"), folded)).otherwise(path)


def resolve_reference(ref: Column, base: Column) -> Column:
    """The URL that a reference in a document with URL ``base`` names (RFC 3986, section 5.2). A reference with a scheme
    stands for itself."""
    def resolved(r: Column, b: Column) -> Column:
        root = F.concat(F.coalesce(F.concat(b["scheme"], F.lit(":")), F.lit("")), b["authority"])
        # the base path up to its last slash; a host without a path has the root
        folder = F.when((b["path"] == "") & (b["authority"] != ""), F.lit("/")).otherwise(
            F.regexp_extract(b["path"], r"(?s)^(.*/)?", 0))
        merged = F.when(r["path"].startswith("/"), r["path"]).otherwise(F.concat(folder, r["path"]))
        return (F.when(r["scheme"].isNotNull(), ref)
                .when(r["authority"] != "", F.concat(F.coalesce(F.concat(b["scheme"], F.lit(":")), F.lit("")), r["authority"],
                                                     remove_dot_segments(r["path"]), r["query"], r["fragment"]))
                .when(r["path"] != "", F.concat(root, remove_dot_segments(merged), r["query"], r["fragment"]))
                .when(r["query"] != "", F.concat(root, b["path"], r["query"], r["fragment"]))
                .otherwise(F.concat(root, b["path"], b["query"], r["fragment"])))

    return let(F.struct(_reference_parts(ref).alias("r"), _reference_parts(base).alias("b")), lambda p: resolved(p["r"], p["b"]))
