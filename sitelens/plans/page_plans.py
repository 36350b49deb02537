"""Page, URL and link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..operators import links as K
from ..operators import pages as P
from ..sources import tables as S
from ..sources.materialise import written
from .registry import query

TAGS = ["script", "style", "nav", "footer", "header", "aside", "form", "button"]
TERMS = ["the", "data", "bot"]


def _stripped(column: str, tags: list[str] = TAGS) -> str:
    for t in tags:
        column = rf"regexp_replace({column}, '(?is)<{t}\b.*?</{t}>', ' ', 'g')"
    return rf"regexp_replace({column}, '(?s)<!--.*?-->', ' ', 'g')"


TEXT = rf"trim(regexp_replace(regexp_replace({_stripped('html')}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
TITLE = "coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)), ''), '')"
LINKS = """SELECT page_id, url, host, CAST(ord AS BIGINT) AS ord, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS text FROM (SELECT page_id, url, host, unnest(l) AS a, unnest(range(len(l))) AS ord FROM (SELECT page_id, url, host, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages_v)) WHERE length(trim(regexp_extract(a, '>([^<]*)<', 1))) > 0"""
ABSOLUTE = """CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END"""
ANY = lambda c: "(" + " OR ".join(f"contains({c}, '{t}')" for t in TERMS) + ")"


def pages(spark, d):
    return S.pages(spark, d)


def links(spark, d):
    return P.links(pages(spark, d)).withColumn("ord", F.col("ord").cast("long"))


def titles(spark, d):
    return pages(spark, d).select("page_id", P.title(F.col("html")).alias("title"))


def dom(spark, d):
    """The node table: pages are parsed once and written, whatever reads it."""
    return written(P.nodes(pages(spark, d)))


def texts(spark, d):
    return P.subtree_text(dom(spark, d))


def clean_texts(spark, d):
    """Texts of what is left without boilerplate, written: selectors read them more than once."""
    return written(P.subtree_text(dom(spark, d), P.boilerplate()))


@query("src1_captured_pages", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages")
def src1(spark, d):
    return pages(spark, d).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("pg1_dom_nodes")
def pg1(spark, d):
    return P.nodes(pages(spark, d))


@query("pg2_boilerplate_removed", f"SELECT page_id, {TEXT} AS content FROM pages")
def pg2(spark, d):
    return pages(spark, d).select("page_id", P.plain_text(F.col("html"), TAGS).alias("content"))


TAGS_14 = _stripped("html", L.REMOVED_TAGS_PLAIN)


@query("pg2_plain_tags_removed", rf"SELECT page_id, trim(regexp_replace(regexp_replace({TAGS_14}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM pages")
def pg2_plain(spark, d):
    return pages(spark, d).select("page_id", P.plain_text(F.col("html"), L.REMOVED_TAGS_PLAIN).alias("content"))


@query("pg2_selectors_removed")
def pg2_selectors(spark, d):
    return P.without_selectors(dom(spark, d)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("pg3_pattern_removed")
def pg3(spark, d):
    return P.without_boilerplate(dom(spark, d)).groupBy("page_id").agg(F.count("*").alias("n_nodes"))


@query("pg4_non_empty_elements")
def pg4(spark, d):
    return P.non_empty(clean_texts(spark, d)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("pg5_main_content")
def pg5(spark, d):
    return P.main_content(dom(spark, d), P.boilerplate())


@query("pg5_first_present")
def pg5_first(spark, d):
    return P.main_content(dom(spark, d), F.col("tag").isin(TAGS), first_present=True)


@query("pg6_kept_lines", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 0), chr(10)) AS content FROM documents")
def pg6(spark, d):
    return S.read(spark, d, "documents").select("doc_id", T.kept_lines(F.col("text")).alias("content"))


@query("pg7_single_line", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS content FROM documents")
def pg7(spark, d):
    return S.read(spark, d, "documents").select("doc_id", T.single_line(F.col("text")).alias("content"))


@query("pg8_short_lines_dropped", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 2), chr(10)) AS content FROM documents")
def pg8(spark, d):
    return S.read(spark, d, "documents").select("doc_id", T.kept_lines(F.col("text"), 2).alias("content"))


@query("pg9_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def pg9(spark, d):
    return titles(spark, d)


@query("pg10_meta")
def pg10(spark, d):
    return P.meta(dom(spark, d))


@query("pg10_page_meta", "SELECT page_id, nullif(regexp_extract(html, '(?is)<meta name=\"description\" content=\"([^\"]*)\"', 1), '') AS description, '' AS og FROM pages")
def pg10_page(spark, d):
    """One row for each page; the tables' pages have no meta tags, fixtures do."""
    out = P.page_meta(pages(spark, d), dom(spark, d))
    og = F.array_join(F.transform(F.array_sort(F.map_entries("og")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("page_id", "description", og.alias("og"))


@query("pg11_headings", "SELECT page_id, CAST(ord AS BIGINT) AS ord, CAST(regexp_extract(h, '(?i)<h([1-6])', 1) AS INTEGER) AS level, trim(regexp_extract(h, '>([^<]*)<', 1)) AS text FROM (SELECT page_id, unnest(l) AS h, unnest(range(len(l))) AS ord FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>[^<]*</h[1-6]>') AS l FROM pages)) WHERE length(trim(regexp_extract(h, '>([^<]*)<', 1))) > 0")
def pg11(spark, d):
    return P.headings(pages(spark, d)).withColumn("ord", F.col("ord").cast("long"))


@query("pg12_sections")
def pg12(spark, d):
    return P.sections(dom(spark, d))


@query("pg13_lists")
def pg13(spark, d):
    return P.lists(dom(spark, d))


@query("pg14_links", f"SELECT page_id, ord, href, text FROM ({LINKS})")
def pg14(spark, d):
    return links(spark, d).select("page_id", "ord", "href", "text")


@query("pg14_first_links", f"SELECT page_id, ord, href, substr(text, 1, 100) AS text FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS r FROM ({LINKS})) WHERE r <= 20")
def pg14_first(spark, d):
    return P.first_links(links(spark, d))


@query("pg15_faq_pairs")
def pg15(spark, d):
    return P.faq_pairs(clean_texts(spark, d), titles(spark, d))


@query("pg16_heading_features")
def pg16(spark, d):
    return P.heading_features(texts(spark, d), ["the", "er", "an"])


@query("pg17_list_item_features", f"SELECT page_id, CAST(ord AS BIGINT) AS ord, text FROM (SELECT page_id, ord, trim(regexp_extract(li, '>([^<]*)<', 1)) AS text FROM (SELECT page_id, unnest(l) AS li, unnest(range(len(l))) AS ord FROM (SELECT page_id, regexp_extract_all(html, '(?is)<(?:li|p)>[^<]*</(?:li|p)>') AS l FROM pages))) WHERE length(text) BETWEEN 6 AND 199 AND {ANY('lower(text)')}")
def pg17(spark, d):
    return P.list_item_features(pages(spark, d), TERMS).withColumn("ord", F.col("ord").cast("long"))


@query("pg18_section_blocks")
def pg18(spark, d):
    words = spark.createDataFrame([("the",), ("er",), ("an",)], "keyword string")
    return P.section_blocks(texts(spark, d), words)


@query("pg19_link_features", f"""WITH hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS r FROM ({LINKS}) WHERE {ANY('lower(text)')}) WHERE r <= 10)
SELECT page_id, text AS title, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || href END AS link FROM hit UNION ALL SELECT page_id, {TITLE}, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM hit)""")
def pg19(spark, d):
    return P.link_features(links(spark, d), pages(spark, d), TERMS)


@query("pg20_preview", "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 300) || '...' ELSE 'Page: ' || text END AS preview FROM documents")
def pg20(spark, d):
    return S.read(spark, d, "documents").select("doc_id", P.preview(F.col("text")).alias("preview"))


@query("pg21_whole_sentences", r"""SELECT doc_id, trim(coalesce(string_agg(s || ' ', '' ORDER BY i) FILTER (run <= 1500), '')) AS content FROM (SELECT doc_id, i, s, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM
(SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents))) GROUP BY doc_id""")
def pg21(spark, d):
    return P.whole_sentences(S.read(spark, d, "documents"), "doc_id", "text")


@query("pg22_hard_caps", "SELECT doc_id, substr(text, 1, 1500) AS cap_1500, CAST(length(substr(text, 1, 8000)) AS BIGINT) AS n_8000 FROM documents")
def pg22(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.substring("text", 1, 1500).alias("cap_1500"), F.length(F.substring("text", 1, 8000)).cast("long").alias("n_8000"))


@query("pg23_long_pages", f"SELECT page_id FROM pages WHERE length({TEXT}) > 100")
def pg23(spark, d):
    return pages(spark, d).filter(F.length(P.plain_text(F.col("html"), TAGS)) > 100).select("page_id")


@query("pg24_relevant_blocks")
def pg24(spark, d):
    return P.relevant_blocks(texts(spark, d), TERMS)


@query("url1_absolute", f"SELECT page_id, ord, {ABSOLUTE} AS target FROM ({LINKS})")
def url1(spark, d):
    return links(spark, d).select("page_id", "ord", K.absolute(F.col("url"), F.col("href")).alias("target"))


@query("url2_same_site", r"SELECT page_id, host = 'a.example.com' AS exact, host = 'example.com' OR ends_with(host, '.example.com') AS below, host = 'example.com' OR ends_with(host, '.example.com') OR ends_with('example.com', '.' || host) AS suffix, contains(host, 'example') OR contains('example', host) AS substring FROM pages_v")
def url2(spark, d):
    h = F.col("host")
    return pages(spark, d).select("page_id", K.same_site(h, F.lit("a.example.com"), "exact").alias("exact"), K.same_site(h, F.lit("example.com"), "below").alias("below"), K.same_site(h, F.lit("example.com")).alias("suffix"), K.same_site(h, F.lit("example"), "substring").alias("substring"))


INCLUDE, EXCLUDE = ["*.html", "*article*", "https://*", "http://*example*/*-*"], ["*utm_*", "*#top"]
GLOBS = "(ends_with(url, '.html') OR contains(url, 'article') OR starts_with(url, 'https://') OR regexp_matches(url, '^http://.*example.*/.*-')) AND NOT (contains(url, 'utm_') OR ends_with(url, '#top'))"


@query("url3_globs", f"SELECT page_id, url FROM pages WHERE {GLOBS}")
def url3(spark, d):
    u = F.col("url")
    return pages(spark, d).filter(K.matches_glob(u, INCLUDE) & ~K.matches_glob(u, EXCLUDE)).select("page_id", "url")


@query("url4_eligible", f"SELECT url FROM pages_v WHERE {GLOBS} AND (host = 'example.com' OR ends_with(host, '.example.com')) AND url NOT IN (SELECT url FROM pages WHERE page_id % 10 = 0)")
def url4(spark, d):
    p = pages(spark, d)
    return K.eligible(p.select("url"), p.filter("page_id % 10 = 0"), "example.com", INCLUDE, EXCLUDE)


@query("url5_first_links", f"SELECT href, page_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, ord) AS r FROM ({LINKS})) WHERE r = 1")
def url5(spark, d):
    return K.first_of_each(links(spark, d).select("href", "page_id", "ord"), "href", "page_id", "ord")


@query("url6_help_first", f"SELECT page_id, ord, is_help, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id, is_help ORDER BY ord) AS rank FROM (SELECT *, regexp_matches(lower(href), 'help|guide|docs|about') AS is_help FROM ({LINKS}))) WHERE is_help OR rank <= 5")
def url6(spark, d):
    out = K.help_first(links(spark, d), F.lower("href").rlike("help|guide|docs|about"))
    return out.select("page_id", "ord", "is_help", F.col("rank").cast("long").alias("rank"))


@query("url7_feature_links", f"SELECT page_id, ord, href, text FROM ({LINKS}) WHERE length(text) BETWEEN 3 AND 149 AND ({ANY('lower(text)')} OR {ANY('lower(href)')})")
def url7(spark, d):
    return K.feature_links(links(spark, d), lambda c: T.has_any(c, TERMS)).select("page_id", "ord", "href", "text")


REACH = """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey * 7 % (SELECT max(c_custkey) FROM customer) + 1 AS dst FROM orders),
s AS (SELECT c_custkey AS url, CASE WHEN c_mktsegment = 'BUILDING' THEN 'initial' ELSE 'sitemap' END AS source FROM customer WHERE c_acctbal >= (SELECT max(c_acctbal) - 50 FROM customer)),
r AS (SELECT url, 0 AS depth FROM s UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 3), d AS (SELECT url, min(depth) AS depth FROM r GROUP BY url),
p AS (SELECT dst AS url, min(src) AS parent FROM e JOIN d x ON x.url = src JOIN d y ON y.url = dst WHERE y.depth = x.depth + 1 GROUP BY dst)
SELECT url, depth, coalesce(s.source, 'link') AS source, CASE WHEN s.url IS NULL THEN parent END AS parent FROM d LEFT JOIN s USING (url) LEFT JOIN p USING (url)"""


def customer_links(spark, d):
    """(edges, seeds): customers as pages, every order as a link, the richest customers as seeds."""
    c = S.read(spark, d, "customer")
    top = c.agg(F.max("c_custkey").alias("n"), (F.max("c_acctbal") - 50).alias("least"))
    o = S.read(spark, d, "orders").crossJoin(F.broadcast(top))
    edges = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % F.col("n") + 1).alias("dst")).distinct()
    source = F.when(F.col("c_mktsegment") == "BUILDING", "initial").otherwise("sitemap")
    return written(edges), c.crossJoin(F.broadcast(top)).filter("c_acctbal >= least").select(F.col("c_custkey").alias("url"), source.alias("source"))


@query("url8_reach", REACH)
def url8(spark, d):
    """Three steps far from the seeds."""
    return K.reach(*customer_links(spark, d), 3, written)


@query("url8_reach_within_budget", f"SELECT * FROM ({REACH}) ORDER BY depth, url LIMIT 300")
def url8_budget(spark, d):
    """The same until 300 pages are reached; what is beyond is never joined."""
    return K.reach(*customer_links(spark, d), 3, written, 300)


@query("url9_child_pages", f"WITH l AS (SELECT *, {ABSOLUTE} AS child FROM ({LINKS})) SELECT page_id, child, title || ' - ' || text AS title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS r FROM l WHERE starts_with(child, regexp_extract(url, '^(https?://[^/?#]+)', 1)) AND child <> url) JOIN (SELECT page_id, {TITLE} AS title FROM pages) USING (page_id) WHERE r <= 10")
def url9(spark, d):
    return K.child_pages(links(spark, d), titles(spark, d), F.regexp_extract("url", "^(https?://[^/?#]+)", 1))


@query("url10_index_expansion", f"WITH l AS (SELECT * FROM ({LINKS})), f AS (SELECT page_id AS from_page, {ABSOLUTE} AS via FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS r FROM l WHERE ord < 3) WHERE r <= 5) SELECT from_page, via, {ABSOLUTE} AS target, text FROM f JOIN l ON l.url = via")
def url10(spark, d):
    return K.index_expansion(links(spark, d), F.col("ord") < 3)


@query("url11_company", r"SELECT page_id, CASE WHEN length(split_part(regexp_replace(host, '^www\.', ''), '.', 1)) > 0 THEN split_part(regexp_replace(host, '^www\.', ''), '.', 1) ELSE 'Unknown' END AS company FROM pages_v")
def url11(spark, d):
    return pages(spark, d).select("page_id", K.company(F.col("url")).alias("company"))


@query("url12_valid_urls", r"SELECT page_id, ord, coalesce(regexp_matches(href, '^https?://[^/?#\s]+'), false) AS valid FROM (" + LINKS + ")")
def url12(spark, d):
    return links(spark, d).select("page_id", "ord", K.is_valid(F.col("href")).alias("valid"))


@query("url13_crawl_statistics", "SELECT domain, CAST(count(*) AS BIGINT) AS total, CAST(count_if(ok) AS BIGINT) AS successful, CAST(count_if(NOT ok) AS BIGINT) AS failed, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration_s FROM events_v GROUP BY domain")
def url13(spark, d):
    return K.crawl_statistics(S.job_events(spark, d), "domain")
