"""Captured map / scrape / crawl JSON payloads → fixed-schema rows.

Payload shapes vary (object or bare list; a link is a string or an object), so map payloads
are read as VARIANT and branched on the element's type; scrape and crawl payloads have a
fixed shape and go through ``from_json``. Failed parses keep the row, with
``success = false`` and an ``error``; an empty list gives one row without a link or page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRAWL_ITEM = "struct<markdown:string,url:string,title:string,metadata:map<string,string>>"
NO_LINKS = "no list of links"
NO_PAGES = "no list of pages"
NO_OBJECT = "not a JSON object"
SCRAPE_SCHEMA = "struct<markdown:string,title:string,metadata:map<string,string>>"


def normalize_links(raw: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Map response → one row per link ``(…, pos, url, title)``.

    The response is an object with ``links`` or a bare list; each link is a string or an object
    ``{url|link, title}``; ``link`` is used only when the key ``url`` is absent; neither → ''.
    """
    keep = [c for c in raw.columns if c != payload_col]
    v = F.try_parse_json(F.col(payload_col))
    arr = F.when(F.schema_of_variant(v).startswith("OBJECT"),
                 F.try_variant_get(v, "$.links", "array<variant>")).otherwise(F.try_variant_get(v, "$", "array<variant>"))
    exploded = raw.select(*keep, F.posexplode_outer(arr).alias("pos", "_e"), arr.isNotNull().alias("success"))
    e = F.col("_e")
    is_str = F.schema_of_variant(e) == "STRING"
    is_obj = F.schema_of_variant(e).startswith("OBJECT")
    url_obj = F.when(F.variant_get(e, "$.url", "variant").isNotNull(), F.try_variant_get(e, "$.url", "string")) \
        .otherwise(F.coalesce(F.try_variant_get(e, "$.link", "string"), F.lit("")))
    return exploded.select(
        *keep, F.col("pos").cast("bigint").alias("pos"),
        F.when(is_str, F.try_variant_get(e, "$", "string")).when(is_obj, url_obj).alias("url"),
        F.when(is_obj, F.try_variant_get(e, "$.title", "string")).alias("title"),
        "success", F.when(~F.col("success"), F.lit(NO_LINKS)).alias("error"),
    )


def normalize_scrape_payload(raw: DataFrame, payload_col: str = "payload", url_col: str = "url") -> DataFrame:
    """Scrape response → ``markdown, title, metadata``; title = metadata title, else top-level title
    (empty strings count as missing, like Python ``or``); ``metadata.source_url`` is always the URL."""
    keep = [c for c in raw.columns if c != payload_col]
    p = F.from_json(F.col(payload_col), SCRAPE_SCHEMA)
    meta = F.coalesce(p["metadata"], F.create_map().cast("map<string,string>"))
    meta_title = meta["title"]
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(payload_col))).startswith("OBJECT"), F.lit(False))
    return raw.select(
        *keep,
        F.coalesce(p["markdown"], F.lit("")).alias("markdown"),
        F.when(F.coalesce(meta_title, F.lit("")) != "", meta_title).otherwise(p["title"]).alias("title"),
        F.map_concat(F.map_filter(meta, lambda k, _: k != "source_url"),
                     F.create_map(F.lit("source_url"), F.col(url_col))).alias("metadata"),
        is_object.alias("success"), F.when(~is_object, F.lit(NO_OBJECT)).alias("error"),
    )


def normalize_crawl_payload(raw: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Crawl response (``data[]`` or a bare list) → one row per page; url = ``metadata.url`` if that
    key exists, else the item's ``url``, else ''; title = ``metadata.title``."""
    keep = [c for c in raw.columns if c != payload_col]
    bare = F.ltrim(F.col(payload_col)).startswith("[")
    items = F.when(bare, F.from_json(F.col(payload_col), f"array<{CRAWL_ITEM}>")).otherwise(
        F.from_json(F.col(payload_col), f"struct<data:array<{CRAWL_ITEM}>>")["data"])
    exploded = raw.select(*keep, F.posexplode_outer(items).alias("pos", "_i"), items.isNotNull().alias("success"))
    meta = F.coalesce(F.col("_i.metadata"), F.create_map().cast("map<string,string>"))
    return exploded.select(
        *keep, F.col("pos").cast("bigint").alias("pos"),
        F.when(F.map_contains_key(meta, "url"), meta["url"]).otherwise(F.coalesce(F.col("_i.url"), F.lit(""))).alias("url"),
        F.coalesce(F.col("_i.markdown"), F.lit("")).alias("markdown"),
        meta["title"].alias("title"),
        "success", F.when(~F.col("success"), F.lit(NO_PAGES)).alias("error"),
    )
