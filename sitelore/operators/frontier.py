"""Link frontier: clean, deduplicate, filter, classify and title discovered links for all sites.

Input frontier schema: ``course_id string, ord bigint, url string, title string`` (``ord`` = source
position; "first" always means smallest ``ord``). Course table: ``course_id, url`` (site root).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelore.functions import rules, urls
from sitelore.sources.store import BucketTable


def prepare_frontier(links: DataFrame) -> DataFrame:
    """Strip URLs (Python ``str.strip``), split them once and keep what later steps need.

    Adds ``canonical`` (dedup key), ``path`` (urlparse path, for classification and titles) and
    ``url_base`` (base domain, for the same-site check). Carrying these two small strings through
    the dedup aggregate means no later filter re-derives them from the URL: after the aggregate
    they are plain attributes, so predicate pushdown cannot inline the URL split again.
    """
    clean = links.withColumn("url", urls.py_strip(F.col("url")))
    parted = urls.with_url_parts(clean, "url", "_u")
    return parted.select(*clean.columns, urls.canonical_of(F.col("_u")).alias("canonical"),
                         F.col("_u.path").alias("path"), urls.base_domain_of(F.col("_u")).alias("url_base"))


def dedupe_links(frontier: DataFrame, with_count: bool = False) -> DataFrame:
    """Keep the first link (by ``ord``, tie ``url``) per ``(course_id, canonical)``.

    Runs before the relevance filter (a fragment link can shadow its clean twin). Expressed as
    ``min_by`` so the map side pre-aggregates: the shuffle carries at most one row per key and
    map task, and a hot site is split across all tasks because the key includes the URL.
    """
    if "canonical" not in frontier.columns:
        frontier = prepare_frontier(frontier)
    payload_cols = [c for c in frontier.columns if c not in ("course_id", "canonical")]
    first = F.min_by(F.struct(*[F.col(c) for c in payload_cols]), F.struct("ord", "url"))
    aggs = [first.alias("_first")]
    if with_count:
        aggs.append(F.count(F.lit(1)).alias("n_links"))
    out = frontier.groupBy("course_id", "canonical").agg(*aggs)
    cols = ["course_id", "canonical"] + [F.col(f"_first.{c}").alias(c) for c in payload_cols]
    if with_count:
        cols.append("n_links")
    return out.select(*cols)


def with_course_base(df: DataFrame, courses: DataFrame) -> DataFrame:
    """Attach ``course_base`` (the site's base domain). The course table has one row per site;
    AQE broadcasts it when its measured size is under the threshold, else it is shuffle-joined."""
    base = courses.select("course_id", urls.base_domain(F.col("url")).alias("course_base"))
    return df.join(base, "course_id", "left").withColumn("course_base", F.coalesce("course_base", F.lit("")))


def relevance_flag(df: DataFrame) -> Column:
    """Relevance of each row of a prepared frontier (needs ``url, url_base, course_base``)."""
    return rules.is_relevant(F.col("url"), F.col("course_base"), F.col("url_base"))


def classify_links(df: DataFrame) -> DataFrame:
    """Add ``content_type`` and the display ``title`` (given title, else one derived from the path)."""
    return df.withColumns({
        "content_type": F.expr(rules.classify_sql("path", "title")),
        "title": F.coalesce(F.nullif(F.col("title"), F.lit("")), urls.title_from_path(F.col("path"))),
    })


def discover_pages(links: DataFrame, courses: DataFrame, filter_first: bool = False,
                   stable_ids: bool = False, with_ord: bool = False) -> DataFrame:
    """Frontier → classified pages: ``course_id, page_id, url, canonical, title, content_type``.

    ``page_id`` is the ``ord`` of the surviving link, unique within its site. ``stable_ids=True``
    takes a 63-bit hash of site and canonical URL instead, which a frontier whose positions have
    shifted keeps.
    ``with_ord`` adds the position. ``filter_first=True`` applies the relevance filter before deduplication instead of after.
    """
    prepared = prepare_frontier(links)
    if filter_first:
        based = with_course_base(prepared, courses)
        kept = dedupe_links(based.filter(relevance_flag(based)))
    else:
        deduped = with_course_base(dedupe_links(prepared), courses)
        kept = deduped.filter(relevance_flag(deduped))
    pages = classify_links(kept)
    page_id = F.shiftrightunsigned(F.xxhash64("course_id", "canonical"), 1) if stable_ids else F.col("ord")
    return pages.select("course_id", page_id.alias("page_id"), "url", "canonical", "title", "content_type",
                        *(["ord"] if with_ord else []))


def rediscover(before: DataFrame, after: DataFrame) -> DataFrame:
    """Difference of two discoveries of the same sites (``discover_pages`` with ``stable_ids``), one row per page of either.

    ``change``: ``added``, ``vanished``, ``moved`` (another position ``ord`` in the frontier), ``changed`` (another URL
    spelling, title or type; it wins over a move) or ``kept``. Ids come from site and canonical URL, so a page keeps its
    id whatever happens to its neighbours. Values are those of ``after``, for a vanished page of ``before``.
    """
    key, values = ["course_id", "page_id"], ["url", "canonical", "title", "content_type", "ord"]
    old = before.select(*key, F.struct(*values).alias("_old"))
    new = after.select(*key, F.struct(*values).alias("_new"))
    both = old.join(new, key, "full_outer")
    same = [F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in values]
    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "vanished")
              .when(~(same[0] & same[2] & same[3]), "changed").when(~same[4], "moved").otherwise("kept"))
    return both.select(*key, change.alias("change"),
                       *[F.coalesce(F.col("_new"), F.col("_old"))[c].alias(c) for c in values if c != "ord"],
                       F.col("_old.ord").alias("old_ord"), F.col("_new.ord").alias("new_ord"))


def store_rediscovery(pages: BucketTable, difference: DataFrame) -> None:
    """Take a difference over into the stored pages (``course_id, page_id, url, title, content_type, status``): pages added
    or changed are written, vanished ones stay with the status ``vanished``; all others, and their status, stay."""
    rows = difference.where("change IN ('added', 'changed', 'vanished')")
    held = pages.read().select("course_id", "page_id", F.col("status").alias("_status"))
    status = (F.when(F.col("change") == "vanished", "vanished").when(F.col("_status") == "vanished", "discovered")
              .otherwise(F.coalesce("_status", F.lit("discovered"))))
    new = rows.join(held, ["course_id", "page_id"], "left").withColumn("status", status)
    pages.upsert(new.select(*pages.read().columns))


def discovery_stats(links: DataFrame, courses: DataFrame) -> DataFrame:
    """Per site: links mapped, unique canonical URLs, pages kept, and kept pages per content type.

    Two partially aggregated shuffles (dedup key, then site); the site table join is broadcast
    by AQE when small.
    """
    deduped = with_course_base(dedupe_links(prepare_frontier(links), with_count=True), courses)
    keep = deduped.withColumn("_keep", relevance_flag(deduped))
    # only kept links are counted by type, so only they are classified (titles are not needed)
    flagged = keep.withColumn("content_type", F.when(F.col("_keep"), F.expr(rules.classify_sql("path", "title"))))
    aggs = [
        F.sum("n_links").cast("bigint").alias("mapped"),
        F.count(F.lit(1)).alias("unique_urls"),
        F.count_if(F.col("_keep")).alias("kept"),
    ]
    aggs += [F.count_if(F.col("_keep") & (F.col("content_type") == t)).alias(f"n_{t}") for t in rules.CONTENT_TYPES]
    return flagged.groupBy("course_id").agg(*aggs)


def limit_frontier(links: DataFrame, n: int = 500) -> DataFrame:
    """Keep the first ``n`` links per site by ``ord`` (map cap 500, crawl cap 100).

    ``row_number() <= n`` is planned as a WindowGroupLimit, which trims every map partition to
    ``n`` rows per site before the shuffle, so even a huge site moves only ``n`` rows per task.
    """
    w = Window.partitionBy("course_id").orderBy("ord", "url")
    return links.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
