"""URLs and the link graph."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^https?://([^/?#:]+)"


def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def absolute(base: Column, href: Column) -> Column:
    """http links as they are, root-relative ones on the base's origin, others below the base's folder."""
    origin = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), "[^/]*$", "")
    folder = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))


def same_site(a: Column, b: Column, mode: str = "suffix") -> Column:
    """Whether host a belongs to host b: exact, suffix (either way), below (a under b), substring (either way)."""
    below = lambda x, y: (x == y) | x.endswith(F.concat(F.lit("."), y))
    if mode == "exact":
        return a == b
    if mode == "below":
        return below(a, b)
    if mode == "substring":
        return a.contains(b) | b.contains(a)
    return below(a, b) | below(b, a)


def matches_glob(url: Column, patterns: list[str]) -> Column:
    """*x* contains, *x ends with, x* starts with, x contains; a * inside stands for anything.  One predicate for all patterns."""
    out = F.lit(False)
    for p in patterns:
        body = p.strip("*")
        if "*" in body:
            inner = ".*".join(re.escape(x) for x in body.split("*"))
            open_end = p.endswith("*") or not p.startswith("*")
            out = out | url.rlike(("" if p.startswith("*") or not p.endswith("*") else "^") + inner + ("" if open_end else "$"))
        elif p.startswith("*") and not p.endswith("*"):
            out = out | url.endswith(body)
        elif p.endswith("*") and not p.startswith("*"):
            out = out | url.startswith(body)
        else:
            out = out | url.contains(body)
    return out


def eligible(urls: DataFrame, visited: DataFrame, base: str, include: list[str], exclude: list[str], mode: str = "below") -> DataFrame:
    """URLs not visited, not excluded, included if includes are given, and of the base's site."""
    ok = ~matches_glob(F.col("url"), exclude) & same_site(host(F.col("url")), F.lit(base), mode)
    if include:
        ok = ok & matches_glob(F.col("url"), include)
    return urls.filter(ok).join(visited.select("url"), "url", "left_anti")


def first_of_each(links: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; by partial aggregation, so a key that many pages share is combined before the shuffle."""
    return links.groupBy(key).agg(F.min_by(F.struct(*[c for c in links.columns if c != key]), F.struct(*order)).alias("first")).select(key, "first.*")


def help_first(links: DataFrame, is_help: Column, others: int = 5) -> DataFrame:
    """All help-like links of a page, then its first other ones."""
    marked = links.withColumn("is_help", is_help)
    rank = F.row_number().over(Window.partitionBy("page_id", "is_help").orderBy("ord"))
    return marked.withColumn("rank", rank).filter(F.col("is_help") | (F.col("rank") <= others))


def feature_links(links: DataFrame, has_term: Callable[[Column], Column], least: int = 3, most: int = 149) -> DataFrame:
    """Links with a title of the given lengths and a feature word in title or address."""
    return links.filter(F.length("text").between(least, most) & (has_term(F.lower("text")) | has_term(F.lower("href"))))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, keep: Callable[[DataFrame], DataFrame], max_pages: int | None = None) -> DataFrame:
    """Breadth-first reach over (src, dst) from seeds (url[, source]): (url, depth, source, parent).

    source: the seed's own, of several the smallest, or 'link'; parent: the smallest page of the level before that links there, null
    for seeds.  Each level joins the frontier and leaves out what is visited.  Of the level that meets the budget max_pages the
    first by url are kept, and no further level runs.  `keep` materialises a level (a written table or checkpoint), so lineage
    does not grow with depth.
    """
    kind = dict(edges.dtypes)["src"]
    given = seeds if "source" in seeds.columns else seeds.withColumn("source", F.lit("initial"))
    level = given.groupBy("url").agg(F.min("source").alias("source")).select("url", F.lit(0).alias("depth"), "source", F.lit(None).cast(kind).alias("parent"))
    visited, n = None, 0
    for depth in range(max_depth + 1):
        level = keep(level)
        size = level.count()
        if max_pages is not None and n + size >= max_pages:
            level = level.orderBy("url").limit(max_pages - n)
            return level if visited is None else visited.unionByName(level)
        n += size
        visited = level if visited is None else keep(visited.unionByName(level))
        if not size or depth == max_depth:
            return visited
        found = edges.join(level.select(F.col("url").alias("src")), "src").groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("parent"))
        level = found.join(visited.select("url"), "url", "left_anti").select("url", F.lit(depth + 1).alias("depth"), F.lit("link").alias("source"), "parent")
    return visited


def child_pages(links: DataFrame, titles: DataFrame, parent: Column | None = None, n: int = 10) -> DataFrame:
    """Pages that a page links to below itself (or below the given parent address), the first n, titled 'parent - child'."""
    root = F.col("url") if parent is None else parent
    below = links.withColumn("child", absolute(F.col("url"), F.col("href"))).filter(F.col("child").startswith(root) & (F.col("child") != F.col("url")))
    kept = below.withColumn("row_no", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).filter(F.col("row_no") <= n)
    return kept.join(titles, "page_id").select("page_id", "child", F.concat("title", F.lit(" - "), "text").alias("title"))


def index_expansion(links: DataFrame, is_index: Column, per_page: int = 5) -> DataFrame:
    """Two hops: the first index-like links of a page, then the links of the pages they lead to."""
    first = links.filter(is_index).withColumn("row_no", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).filter(F.col("row_no") <= per_page)
    hop = first.select(F.col("page_id").alias("from_page"), absolute(F.col("url"), F.col("href")).alias("url"))
    return hop.join(links.select("url", "href", "text", "ord"), "url").select("from_page", F.col("url").alias("via"), absolute(F.col("url"), F.col("href")).alias("target"), "text")


def company(url: Column) -> Column:
    name = F.split_part(F.regexp_replace(host(url), r"^www\.", ""), F.lit("."), F.lit(1))
    return F.when(F.length(name) > 0, name).otherwise("Unknown")


def is_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def crawl_statistics(results: DataFrame, by: str) -> DataFrame:
    duration = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return results.groupBy(by).agg(F.count("*").alias("total"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"), F.round(duration, 3).alias("duration_s"))


def sitemap_urls(bodies: DataFrame) -> DataFrame:
    """(url, loc, is_index) of every <loc> in captured sitemap bodies (url, body)."""
    locs = F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return bodies.select("url", F.col("body").rlike("(?i)<sitemapindex").alias("is_index"), F.explode(locs).alias("loc"))


def robots_seeds(bodies: DataFrame) -> DataFrame:
    """Sitemap lines of captured robots files."""
    return bodies.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1))).alias("loc"))


# Where sitemaps lie by convention.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml"]


def conventional_sitemaps(urls: DataFrame) -> DataFrame:
    """(url): the sitemap addresses that each site of the given addresses may have by convention."""
    origin = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    return urls.select(origin.alias("origin")).filter("origin <> ''").distinct().select(F.explode(F.array(*[F.concat("origin", F.lit(p)) for p in SITEMAP_PATHS])).alias("url"))
