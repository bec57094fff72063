"""HTML we hold → link frontier and page content, as native regex expressions.

Re-aims remote site mapping and scraping: the frontier is derived from the anchors of stored
pages, and content is the page's HTML turned into Markdown-like text. Pages schema:
``page_id bigint, url string, html string``. Everything is a per-row column expression, so a
page is processed where its partition lives; no Python in the hot path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.functions import urls
from sitelore.functions.exprs import let

# What is dropped and how tags map to Markdown (own choices, see README).
# an anchor with a quoted or bare href: the href as written, and all that stands inside
ANCHOR_RE = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)[^>]*>(.*?)</a\s*>"""
BASE_RE = r"""(?is)<base(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
COMMENT_RE = r"(?s)<!--.*?-->"
QUOTES_RE = r"""^["']|["']$"""
DROP_BLOCKS_RE = (r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>"
                  r"|<footer\b.*?</footer>|<head\b.*?</head>")
# what a page is cut into where it holds lists, tables, preformatted text or links
PIECES_RE = (r"(?is)<(?:li|td|th|tr|ul|ol|table)\b[^>]*>\s*|<pre\b[^>]*>\n?|<[a-z/!?][^>]*>|[^<]+|<")
NESTED_RE = r"(?i)<(?:ul|ol|li|table|pre|a)\b"
START_RE = r"""(?is)\sstart\s*=\s*["']?(\d{1,6})\b"""
HREF_RE = r"""(?is)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
# more entities than nearly all pages need, looked for only where one of them stands
MORE_ENTITIES = {"apos": "'", "ndash": "\u2013", "mdash": "\u2014", "hellip": "\u2026", "lsquo": "\u2018", "rsquo": "\u2019",
                 "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "bull": "\u2022", "rarr": "\u2192",
                 "larr": "\u2190", "times": "\u00d7", "deg": "\u00b0", "sect": "\u00a7", "reg": "\u00ae", "trade": "\u2122",
                 "euro": "\u20ac", "pound": "\u00a3"}
# stand for a line break, a blank and a tab of preformatted text until the other white space is settled
KEPT = "\ue000\ue001\ue002"
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
LANG_RE = r'(?is)<html[^>]*\slang="([^"]*)"'


def _character(code: Column) -> Column:
    """The character of a code point, U+FFFD for none."""
    real = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(real, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def _decode_numbers(text: Column) -> Column:
    """``&#NNN;`` and ``&#xHH;`` as characters."""
    def part(x: Column, i: Column) -> Column:
        ten, hexed = F.regexp_extract(x, r"^(\d{1,8});", 1), F.regexp_extract(x, r"^[xX]([0-9a-fA-F]{1,8});", 1)
        rest = F.regexp_replace(x, "^[^;]*;", "")
        return (F.when(i == 0, x).when(ten != "", F.concat(_character(ten.cast("long")), rest))
                .when(hexed != "", F.concat(_character(F.conv(F.when(hexed != "", hexed), 16, 10).cast("long")), rest))
                .otherwise(F.concat(F.lit("&#"), x)))
    return F.array_join(F.transform(F.split(text, "&#"), part), "")


def decode_entities(col: Column) -> Column:
    out = F.when(col.contains("&#"), _decode_numbers(col)).otherwise(col)
    more = out
    for name, ch in MORE_ENTITIES.items():
        more = F.replace(more, F.lit(f"&{name};"), F.lit(ch))
    out = F.when(out.rlike("&(?:" + "|".join(MORE_ENTITIES) + ");"), more).otherwise(out)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "),
                    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def base_url(html: Column, page_url: Column) -> Column:
    """What a page's references are relative to: its first ``<base href>``, itself relative to the page, or the page."""
    href = _href(F.regexp_extract(F.regexp_replace(html, COMMENT_RE, ""), BASE_RE, 1))
    return F.when(href != "", urls.resolve_reference(href, page_url)).otherwise(page_url)


def _href(written: Column) -> Column:
    """An attribute's value without quotes, entities, outer white space and inner line breaks."""
    return urls.py_strip(F.translate(decode_entities(F.regexp_replace(written, QUOTES_RE, "")), "\t\r\n", ""))


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per anchor: ``course_id`` (site host), ``src_page``, ``pos`` (0-based), ``url`` (resolved against the page
    or its ``<base>``), ``title``."""
    based = pages.select("page_id", "url", "html", base_url(F.col("html"), F.col("url")).alias("base"))
    anchors = based.select(
        urls.base_domain(F.col("url")).alias("course_id"),
        F.col("page_id").alias("src_page"), "base",
        F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR_RE), 0)).alias("pos", "_a"),
    )
    href = _href(F.regexp_extract("_a", ANCHOR_RE, 1))
    text = F.regexp_replace(F.regexp_extract("_a", ANCHOR_RE, 2), r"<[^>]*>", "")
    return anchors.select(
        "course_id", "src_page", F.col("pos").cast("bigint").alias("pos"),
        urls.resolve_reference(href, F.col("base")).alias("url"),
        F.nullif(urls.py_strip(decode_entities(text)), F.lit("")).alias("title"),
    )


def _after(state: Column, piece: Column) -> Column:
    """The open lists (with the last number given), tables, rows, cells, preformatted parts and link after a piece."""
    name, lists = piece["name"], state["lists"]
    top = F.get(lists, F.size(lists) - 1)
    below = F.slice(lists, 1, F.greatest(F.size(lists) - 1, F.lit(0)))

    def opened(kind: Column, number: Column) -> Column:
        return F.array(F.struct(kind.alias("ordered"), number.alias("number")))

    outer = state["tables"] <= 1
    inside = state["pre"] > 0
    return F.struct(
        F.when(inside, lists).when(name.isin("ul", "ol"), F.concat(lists, opened(name == "ol", piece["start"])))
        .when(name.isin("/ul", "/ol"), below)
        .when((name == "li") & (F.size(lists) > 0), F.concat(below, opened(top["ordered"], top["number"] + 1)))
        .otherwise(lists).alias("lists"),
        F.when(name == "pre", state["pre"] + 1).when(name == "/pre", F.greatest(state["pre"] - 1, F.lit(0)))
        .otherwise(state["pre"]).alias("pre"),
        F.when(name == "table", state["tables"] + 1).when(name == "/table", F.greatest(state["tables"] - 1, F.lit(0)))
        .otherwise(state["tables"]).alias("tables"),
        F.when((name == "table") & (state["tables"] == 0), 0).when((name == "tr") & outer, state["rows"] + 1)
        .otherwise(state["rows"]).alias("rows"),
        F.when((name == "tr") & outer, 0).when(name.isin("td", "th") & outer, state["cells"] + 1)
        .otherwise(state["cells"]).alias("cells"),
        F.when(name == "a", piece["href"]).when(name == "/a", "").otherwise(state["href"]).alias("href"))


def _written(state: Column, piece: Column) -> Column:
    """What stands for a piece, given what is open before it; other tags than these are left for later."""
    name, text, lists = piece["name"], piece["text"], state["lists"]
    top = F.get(lists, F.size(lists) - 1)
    flat = F.regexp_replace(text, r"\s+", " ")
    mark = F.when(top["ordered"], F.concat((top["number"] + 1).cast("string"), F.lit(". "))).otherwise("- ")
    row_end = F.when(state["rows"] == 1, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), state["cells"]))).otherwise("")
    one, many = state["tables"] == 1, state["tables"] > 1
    return (F.when(name == "pre", F.when(state["pre"] == 0, "\n\n```\n").otherwise(""))
            .when(name == "/pre", F.when(state["pre"] == 1, "\n```\n\n").otherwise(""))
            .when(state["pre"] > 0, F.when(text == "<", "&lt;").when(name == "", F.translate(text, "\n \t", KEPT)).when(name == "br", KEPT[0])
                  .otherwise(""))
            .when(text == "<", "&lt;")
            .when(name == "", F.when(state["tables"] > 0, F.replace(flat, F.lit("|"), F.lit("\\|")))
                  .when(F.size(lists) > 0, flat).otherwise(text))
            .when(name == "li", F.when(state["tables"] > 0, " - ").otherwise(F.concat(
                F.lit("\n"), F.repeat(F.lit("  "), F.greatest(F.size(lists) - 1, F.lit(0))), mark)))
            .when(name.isin("ul", "ol", "/li"), "")
            .when(name.isin("/ul", "/ol"), F.when((F.size(lists) <= 1) & (state["tables"] == 0), "\n\n").otherwise(""))
            .when(name == "table", F.when(state["tables"] == 0, "\n\n").otherwise(" "))
            .when(name == "/table", F.when(one, "\n\n").otherwise(" "))
            .when(one & (name == "tr"), "\n|").when(one & (name == "/tr"), row_end)
            .when(one & name.isin("td", "th"), " ").when(one & name.isin("/td", "/th"), " |")
            .when(many & name.isin("tr", "td", "th"), " ")
            .when((state["tables"] > 0) & name.isin("p", "/p", "br", "div", "/div"), " ")
            .when(name == "a", F.when(piece["href"] != "", "[").otherwise(""))
            .when(name == "/a", F.when(state["href"] != "", F.concat(F.lit("]("), state["href"], F.lit(")"))).otherwise(""))
            .otherwise(text))


def _nested(text: Column) -> Column:
    """Lists, tables, preformatted text and links of a page as Markdown, by one pass over its tags and texts with a stack
    of what is open. The pass goes block by block, each about the square root of all pieces long, since every step copies
    the pieces written so far: a page of n pieces costs n ** 1.5, not the square."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECES_RE), 0), lambda x: F.struct(
        F.lower(F.regexp_extract(x, "^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1)).alias("name"), x.alias("text"),
        _href(F.regexp_extract(x, HREF_RE, 1)).alias("href"),
        (F.coalesce(F.regexp_extract(x, START_RE, 1).try_cast("int"), F.lit(1)) - 1).alias("start")))
    closed = F.struct(F.array().cast("array<struct<ordered:boolean,number:int>>").alias("lists"), F.lit(0).alias("pre"),
                      F.lit(0).alias("tables"), F.lit(0).alias("rows"), F.lit(0).alias("cells"), F.lit("").alias("href"))
    nothing = F.array().cast("array<string>")

    def step(done: Column, piece: Column) -> Column:
        return F.struct(_after(done["state"], piece).alias("state"),
                        F.concat(done["out"], F.array(_written(done["state"], piece))).alias("out"))

    def block(done: Column, part: Column) -> Column:
        return let(F.aggregate(part, F.struct(done["state"].alias("state"), nothing.alias("out")), step), lambda x: F.struct(
            x["state"].alias("state"), F.concat(done["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

    def blocks(all_pieces: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_pieces) + 1)).cast("int")
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.slice(all_pieces, i * size + 1, size))

    return F.aggregate(let(pieces, blocks), F.struct(closed.alias("state"), nothing.alias("out")), block,
                       lambda done: F.array_join(done["out"], ""))


def html_to_markdown(html: Column) -> Column:
    """Drop non-content blocks; headings, nested and numbered lists, tables, preformatted text, links (references as
    written), bold, paragraphs and breaks become Markdown; other tags are stripped. Elements left open end with the page,
    ends without a start count for nothing, a table inside a table is text of its cell."""
    text = F.regexp_replace(html, DROP_BLOCKS_RE, "")
    text = let(text, lambda t: F.when(t.rlike(NESTED_RE), _nested(t)).otherwise(t))
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    text = F.regexp_replace(text, r"(?i)</h[1-6]>", "\n")
    text = F.regexp_replace(text, r"(?i)</?(b|strong)\b[^>]*>", "**")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</?p\b[^>]*>", "\n\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = decode_entities(text)
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.translate(urls.py_strip(text), KEPT, "\n \t")


def extract_content(pages: DataFrame) -> DataFrame:
    """Page HTML → ``title, markdown, metadata map, success`` (empty content ⇒ ``success = false``)."""
    title = urls.py_strip(decode_entities(F.regexp_extract("html", TITLE_RE, 1)))
    out = pages.select(
        "page_id", "url",
        title.alias("title"),
        html_to_markdown(F.col("html")).alias("markdown"),
        F.regexp_extract("html", LANG_RE, 1).alias("_lang"),
    )
    return out.select(
        "page_id", "url", "title", "markdown",
        F.create_map(F.lit("title"), F.col("title"), F.lit("language"), F.col("_lang"),
                     F.lit("source_url"), F.col("url")).alias("metadata"),
        (F.col("markdown") != "").alias("success"),
    )
