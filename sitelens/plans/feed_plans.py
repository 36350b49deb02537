"""Source and streaming queries: each stream runs over the whole table and equals its batch twin's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import links as K
from ..operators import pages as P
from ..sources import files as X
from ..sources import tables as S
from ..sources.materialise import shared_folder, written
from ..streaming import feeds as J
from .page_plans import TITLE
from .registry import query
from .scoring_plans import SUPPORT, keywords


def stream(spark, d):
    e = J.read_stream(spark, d, "events")
    status = F.when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), F.concat(F.lit("site"), F.col("user_id") % 50).alias("domain"), status.alias("status"), (F.col("value") / 100).alias("latency"), (F.col("event_type") != "error").alias("ok"))


def rates(spark):
    return spark.createDataFrame([(f"site{i}", 0.01 * (i + 1)) for i in range(10)], "domain string, rate double")


def folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("src2_new_keywords", """SELECT project_id, keyword, category FROM (SELECT c_nationkey::BIGINT AS project_id, 'k' || (c_custkey % 400) AS keyword, arg_min(c_mktsegment, c_custkey) AS category FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 11 <> 0 GROUP BY 1, 2)
WHERE (project_id, keyword) NOT IN (SELECT (c_nationkey::BIGINT, 'k' || (c_custkey % 400)) FROM customer WHERE c_custkey % 9 = 0)""")
def src2(spark, d):
    """Keyword files of all projects, with blanks around and some keywords blank, imported beside what projects have."""
    k = S.keywords(spark, d).withColumn("keyword", F.when(F.col("keyword_id") % 11 == 0, "  ").otherwise(F.concat(F.lit(" k"), F.col("keyword_id") % 400, F.lit(" "))))
    given = k.filter("keyword_id % 9 <> 0").repartition("project_id").sortWithinPartitions("project_id", "keyword_id")
    X.write_csv(given.select("keyword", "category", "project_id"), path := folder(spark), "project_id")
    return X.import_keywords(spark, path, k.filter("keyword_id % 9 = 0").withColumn("keyword", F.concat(F.lit("k"), F.col("keyword_id") % 400))).withColumn("project_id", F.col("project_id").cast("long"))


@query("src3_export_keywords", "SELECT keyword, CASE WHEN keyword_id % 3 = 0 THEN '' ELSE category END AS category FROM keywords_v")
def src3(spark, d):
    """The export as a CSV file, read back."""
    X.write_csv(X.export_keywords(S.keywords(spark, d).withColumn("category", F.when(F.col("keyword_id") % 3 != 0, F.col("category")))), path := folder(spark))
    return X.read_keywords(spark, path).select("keyword", "category")


@query("src4_crawl_statistics", "SELECT CAST(count(*) AS BIGINT) AS total_pages, CAST(count_if(length(html) > 0) AS BIGINT) AS successful_pages, CAST(sum(length(html)) AS BIGINT) AS n_chars FROM pages")
def src4(spark, d):
    """The statistics of an exported crawl, read from its JSON form."""
    return X.read_crawl(spark, exported(spark, d))[1].drop("config")


def exported(spark, d):
    pages = S.pages(spark, d).select(P.title(F.col("html")).alias("title"), "url", F.col("html").alias("content"))
    X.export_crawl(pages, path := folder(spark), {"max_pages": 100, "max_depth": 3})
    return path


@query("src4_crawl_csv", f"SELECT {TITLE} AS title, url, 0 AS depth, 'initial' AS source, CAST(length(html) AS BIGINT) AS content_length FROM pages")
def src4_csv(spark, d):
    return X.read_crawl(spark, exported(spark, d))[2]


@query("src4_crawl_json", f"SELECT {TITLE} AS title, url, md5(html) AS digest, CAST(length(html) AS BIGINT) AS content_length FROM pages")
def src4_json(spark, d):
    return X.read_crawl(spark, exported(spark, d))[0].select("title", "url", F.md5("content").alias("digest"), "content_length")


@query("src5_analysis_report", "SELECT analysis_id, keyword, category, status, confidence, strftime(analyzed_at, '%Y-%m-%d %H:%M:%S') AS analyzed_at FROM analyses_v JOIN keywords_v USING (keyword_id)")
def src5(spark, d):
    return X.analysis_report(S.analyses(spark, d), S.keywords(spark, d))


@query("src7_parsed_replies", "SELECT event_id AS reply_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src7(spark, d):
    replies = S.read(spark, d, "events").select(F.col("event_id").alias("reply_id"), F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone")).alias("text"))
    return X.parse_replies(replies, "k BIGINT")[0].select("reply_id", F.col("parsed.k").alias("k"))


@query("src7_reply_errors", "SELECT conv_id * 1000 + turn AS reply_id, substr(text, 1, 1000) AS error FROM conversations WHERE NOT contains(text, '{')")
def src7_errors(spark, d):
    c = S.read(spark, d, "conversations").filter(~F.contains("text", F.lit("{"))).select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), "text")
    return X.parse_replies(c)[1]


@query("src8_sitemap_urls", "SELECT page_id, url FROM pages")
def src8(spark, d):
    """Captured sitemaps made of the pages' own URLs: one for each page, an index for each host, and robots files above."""
    p = S.pages(spark, d)
    body = F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url></urlset>"))
    leaves = p.select(F.concat(F.lit("map"), "page_id").alias("url"), body.alias("body"))
    index = p.groupBy("host").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(F.collect_list("page_id"), lambda i: F.concat(F.lit("<sitemap><loc>map"), i.cast("string"), F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body")).select(F.col("host").alias("url"), "body")
    robots = p.groupBy("host").agg(F.concat(F.lit("User-agent: *\nSitemap: "), F.col("host"), F.lit("\n")).alias("body")).select(F.concat("host", F.lit("/robots.txt")).alias("url"), "body")
    locs = written(K.sitemap_urls(leaves.unionByName(index)))
    found = X.nested_sitemaps(locs, K.robots_seeds(robots).select(F.col("loc").alias("url")), written)
    return found.join(p.select("page_id", F.col("url").alias("loc")), "loc").select("page_id", F.col("loc").alias("url"))


@query("src8_conventional_sitemaps", "SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) || p AS url FROM pages, (VALUES ('/sitemap.xml'), ('/sitemap_index.xml'), ('/sitemap/sitemap.xml')) AS t(p)")
def src8_conventional(spark, d):
    return K.conventional_sitemaps(S.pages(spark, d))


PROGRESS = "job_id * event_id % 101"
STATE = f"SELECT job_id, status, progress, CASE WHEN progress < 10 THEN 'init' WHEN progress < 40 THEN 'crawl' WHEN progress < 80 THEN 'analyse' WHEN progress < 90 THEN 'merge' ELSE 'done' END AS step, event_id, n_events FROM (SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max({PROGRESS}, (ts, event_id)) AS progress, arg_max(event_id, (ts, event_id)) AS event_id, CAST(count(*) AS BIGINT) AS n_events FROM events_v GROUP BY job_id)"


@query("str1_job_state", STATE)
def str1(spark, d):
    """In update mode: a batch writes the jobs that it changed, and the latest row of each is read."""
    return J.upserted(J.job_state(stream(spark, d).withColumn("progress", F.expr(PROGRESS))), ["job_id"]).rows()


LIFE = "SELECT job_id, event_id, status, before, NOT coalesce(before IN ('completed', 'failed'), false) AS may_cancel, coalesce(before = 'failed', false) AS may_retry FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM events_v)"


@query("str2_lifecycle", LIFE)
def str2(spark, d):
    return J.lifecycle(S.job_events(spark, d))


@query("str2_lifecycle_stream", LIFE)
def str2_stream(spark, d):
    return J.drained(J.lifecycle_stream(stream(spark, d)), "append")


@query("str3_stage_progress", "SELECT job_id, progress, CASE WHEN progress < 10 THEN 'init' WHEN progress < 40 THEN 'crawl' WHEN progress < 80 THEN 'analyse' WHEN progress < 90 THEN 'merge' ELSE 'done' END AS stage FROM (SELECT user_id AS job_id, max(user_id * event_id % 101 % (user_id % 100 + 1)) AS progress FROM events GROUP BY 1)")
def str3(spark, d):
    e = S.job_events(spark, d).withColumn("progress", F.col("job_id") * F.col("event_id") % 101 % (F.col("job_id") % 100 + 1))
    return J.stage_progress(e)


AUDIT = "SELECT domain, event_id, round(gap, 6) AS gap, round(greatest(1 / coalesce(rate, 1.0) - gap, 0.0), 6) AS delay, n > 3 AS over_burst FROM (SELECT domain, event_id, (us - lag(us) OVER (PARTITION BY domain ORDER BY us, event_id)) / 1e6 AS gap, count(*) OVER (PARTITION BY domain ORDER BY us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, epoch_us(ts) AS us FROM events_v)) LEFT JOIN (SELECT 'site' || i AS domain, 0.01::DOUBLE * (i + 1) AS rate FROM range(10) t(i)) USING (domain)"


@query("str4_rate_audit", AUDIT)
def str4(spark, d):
    return J.rate_audit(S.job_events(spark, d), rates(spark))


@query("str4_rate_windows", "SELECT domain, epoch_us(date_trunc('second', ts)) AS at, CAST(count(*) AS BIGINT) AS n FROM events_v GROUP BY 1, 2")
def str4_stream(spark, d):
    """The windowed counts of the stream in full: complete mode, so that none waits for the watermark."""
    return J.drained(J.rate_windows(stream(spark, d)), "complete").select("domain", F.unix_micros("window.start").alias("at"), "n")


@query("str5_moving_latency", "SELECT domain, event_id, CASE WHEN n >= 5 THEN round(a, 6) END AS average FROM (SELECT domain, event_id, count(*) OVER w AS n, avg(latency) OVER w AS a FROM events_v WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))")
def str5(spark, d):
    return J.moving_latency(S.job_events(spark, d))


@query("str5_adaptive_rate")
def str5_stream(spark, d):
    return J.drained(J.adaptive_rate_stream(stream(spark, d)), "append")


@query("str6_limiter_statistics", f"SELECT domain, requests, delayed, total_delay, min_latency, max_latency, avg_latency FROM (SELECT domain, CAST(count(*) AS BIGINT) AS requests, CAST(count_if(delay > 0) AS BIGINT) AS delayed, round(sum(coalesce(delay, 0.0)), 4) AS total_delay FROM ({AUDIT}) GROUP BY 1) JOIN (SELECT domain, min(latency) AS min_latency, max(latency) AS max_latency, round(avg(latency), 6) AS avg_latency FROM events_v GROUP BY 1) USING (domain)")
def str6(spark, d):
    return J.limiter_statistics(J.rate_audit(S.job_events(spark, d), rates(spark)), S.job_events(spark, d))


@query("str7_dedupe_hour_batch")
def str7_batch(spark, d):
    return J.dedupe_hour(S.job_events(spark, d))


@query("str7_dedupe_hour")
def str7(spark, d):
    return J.drained(J.dedupe_hour_stream(stream(spark, d)), "append")


@query("str8_stream_analysis", SUPPORT)
def str8(spark, d):
    pages = J.read_stream(spark, d, "documents").select(F.lit(0).alias("project_id"), F.col("doc_id").alias("page_id"), F.col("text").alias("content"))
    return J.drained(J.analyse_stream(pages, keywords(spark)), "append").withColumnRenamed("page_id", "doc_id")


@query("str9_discovery_counts", "SELECT status, CAST(count(*) AS BIGINT) AS n FROM events_v GROUP BY status")
def str9(spark, d):
    return J.upserted(J.discovery_counts(stream(spark, d)), ["status"]).rows()
