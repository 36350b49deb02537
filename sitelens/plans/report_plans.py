"""Report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import files as X
from ..sources import tables as S
from ..sources.materialise import shared_folder, written
from .registry import query

COUNTS = "CAST(count(*) AS BIGINT) AS total, CAST(count_if(status = 'O') AS BIGINT) AS n_supported, CAST(count_if(status = '△') AS BIGINT) AS n_partial, CAST(count_if(status = 'X') AS BIGINT) AS n_unsupported"
LIST = """SELECT p.project_id, p.project, CAST(coalesce(k.n, 0) AS BIGINT) AS n_keywords, CAST(coalesce(k.m, 0) AS BIGINT) AS n_analyses FROM projects_v p
LEFT JOIN (SELECT project_id, count(*) AS n, sum(coalesce(a.c, 0)) AS m FROM keywords_v kw LEFT JOIN (SELECT keyword_id, count(*) AS c FROM analyses_v GROUP BY 1) a USING (keyword_id) GROUP BY 1) k USING (project_id)"""
MATRIX = """SELECT k.keyword_id, k.keyword, k.category, CAST(count(a.status) FILTER (a.status = 'O') AS BIGINT) AS n_supported, CAST(count(a.status) FILTER (a.status = '△') AS BIGINT) AS n_partial,
CAST(count(a.status) FILTER (a.status = 'X') AS BIGINT) AS n_unsupported, CAST(count(a.status) AS BIGINT) AS total,
CASE WHEN count(a.status) > 0 THEN round(count(a.status) FILTER (a.status = 'O') / count(a.status)::DOUBLE, 6) ELSE 0.0 END AS support_rate
FROM keywords_v k LEFT JOIN analyses_v a USING (keyword_id) GROUP BY ALL"""


@query("rep1_crawl_status", "SELECT domain, CAST(count(*) AS BIGINT) AS total, " + ", ".join(f"CAST(count_if(status = '{s}') AS BIGINT) AS {s}" for s in ("completed", "running", "failed", "pending")) + " FROM events_v GROUP BY domain")
def rep1(spark, d):
    return R.crawl_status(S.job_events(spark, d), "domain")


@query("rep2_support_counts", f"SELECT {COUNTS} FROM analyses_v")
def rep2(spark, d):
    return R.support_counts(S.analyses(spark, d))


@query("rep3_keyword_matrix", MATRIX)
def rep3(spark, d):
    return R.keyword_matrix(S.keywords(spark, d), S.analyses(spark, d))


@query("rep4_latest_analyses", "SELECT analysis_id, coalesce(keyword, '알 수 없음') AS keyword, status, printf('%.2f', confidence) AS confidence, strftime(analyzed_at, '%Y-%m-%d %H:%M:%S') AS analyzed_at FROM analyses_v LEFT JOIN keywords_v USING (keyword_id) ORDER BY analyses_v.analyzed_at DESC, analysis_id DESC LIMIT 10")
def rep4(spark, d):
    return R.latest_analyses(S.analyses(spark, d), S.keywords(spark, d))


@query("rep5_page_of_analyses", "SELECT analysis_id, status, row_no, total, CAST(ceil(total / 20.0) AS BIGINT) AS n_pages FROM (SELECT analysis_id, status, row_number() OVER (ORDER BY analyzed_at DESC, analysis_id DESC) AS row_no, count(*) OVER () AS total FROM analyses_v WHERE status = 'O') WHERE row_no BETWEEN 41 AND 60")
def rep5(spark, d):
    rows = S.analyses(spark, d).filter("status = 'O'")
    boundaries = R.page_boundaries(rows, "analyzed_at", "analysis_id", 20, written)
    return R.page_of(rows, "analyzed_at", "analysis_id", boundaries, 3, 20).select("analysis_id", "status", "row_no", "total", "n_pages")


@query("rep6_category_statistics", "SELECT category, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 3) AS avg_confidence FROM features_v GROUP BY category")
def rep6(spark, d):
    return R.category_statistics(S.features(spark, d))


@query("rep7_overall_confidence", "SELECT CAST(count(*) AS BIGINT) AS n, round(coalesce(avg(confidence), 0.0), 6) AS avg_confidence FROM features_v")
def rep7(spark, d):
    return R.overall_confidence(S.features(spark, d))


def project_rows(spark, d):
    return R.project_list(S.projects(spark, d), S.keywords(spark, d), S.analyses(spark, d))


@query("rep8_project_list", LIST)
def rep8(spark, d):
    return project_rows(spark, d)


@query("rep9_dashboard", f"SELECT CAST(count(*) AS BIGINT) AS n_projects, CAST(sum(n_keywords) AS BIGINT) AS n_keywords, CAST(sum(n_analyses) AS BIGINT) AS n_analyses FROM ({LIST})")
def rep9(spark, d):
    return R.dashboard(project_rows(spark, d))


@query("rep10_newest_per_job", "SELECT job_id, event_id, status, CAST(row_no AS BIGINT) AS row_no FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS row_no FROM events_v) WHERE row_no <= 10")
def rep10(spark, d):
    return R.newest_per_group(S.job_events(spark, d), "job_id", [F.desc("ts"), F.desc("event_id")], 10).select("job_id", "event_id", "status", F.col("row_no").cast("long").alias("row_no"))


@query("rep11_owned_keywords", "SELECT keyword_id, project_id, keyword FROM keywords_v WHERE project_id IN (SELECT project_id FROM projects_v WHERE owner_id = 2)")
def rep11(spark, d):
    return R.owned(S.keywords(spark, d), S.projects(spark, d), 2).select("keyword_id", "project_id", "keyword")


CARDS = """SELECT p.product, CASE WHEN n > 0 THEN 'O' ELSE 'X' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(cats, '') AS categories, coalesce(names, '') AS names FROM (SELECT DISTINCT product FROM features_v UNION SELECT 'none') p
LEFT JOIN (SELECT product, count(*) AS n FROM features_v GROUP BY 1) c USING (product)
LEFT JOIN (SELECT product, string_agg(category, ', ' ORDER BY first) AS cats FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY first) AS r FROM (SELECT product, category, min(ord) AS first FROM features_v GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1) g USING (product)
LEFT JOIN (SELECT product, string_agg(name, ', ' ORDER BY ord) AS names FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ord) AS r FROM features_v) WHERE r <= 5 GROUP BY 1) t USING (product)"""


def cards(spark, d):
    f = S.features(spark, d)
    products = f.select("product").distinct().unionByName(spark.createDataFrame([("none",)], "product string"))
    return R.product_cards(products, f)


@query("rep12_first_categories_and_names", f"SELECT product, categories, names FROM ({CARDS})")
def rep12(spark, d):
    return cards(spark, d).select("product", "categories", "names")


@query("rep13_product_cards", f"SELECT product, status, n_features FROM ({CARDS})")
def rep13(spark, d):
    return cards(spark, d).select("product", "status", "n_features")


def saved_keywords(spark, d):
    """(table, folder): the keywords saved by project, under a new name."""
    name = f"keywords_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    X.save_by_project(S.keywords(spark, d), name, folder)
    return name, folder


@query("rep14_purge_counts", "SELECT CAST(count_if(project_id = 3) AS BIGINT) AS n_deleted, CAST(count_if(project_id <> 3) AS BIGINT) AS n_kept FROM keywords_v")
def rep14(spark, d):
    """The keywords as a table by project, of which one project is then deleted; counts are of the table itself."""
    table, _ = saved_keywords(spark, d)
    gone = X.purge_project(spark, table, 3)
    return spark.table(table).agg(F.lit(gone).alias("n_deleted"), F.count("*").alias("n_kept"))


@query("rep14_purge_part", "SELECT keyword_id, project_id, keyword, category FROM keywords_v WHERE NOT (project_id = 3 AND category = 'BUILDING')")
def rep14_part(spark, d):
    """Part of a project's rows deleted: only that project's folder is written again."""
    table, _ = saved_keywords(spark, d)
    X.purge_project(spark, table, 3, F.col("category") == "BUILDING")
    return spark.table(table).select("keyword_id", "project_id", "keyword", "category")


@query("rep15_report_content", f"""SELECT 'project' AS section, project AS item, n_keywords AS value FROM ({LIST}) UNION ALL
SELECT 'statistics', unnest(['total', 'O', '△', 'X']), unnest([total, n_supported, n_partial, n_unsupported]) FROM (SELECT {COUNTS} FROM analyses_v) UNION ALL
SELECT 'matrix', category, CAST(sum(n_supported) AS BIGINT) FROM ({MATRIX}) GROUP BY category""")
def rep15(spark, d):
    return R.report_content(project_rows(spark, d), S.analyses(spark, d), R.keyword_matrix(S.keywords(spark, d), S.analyses(spark, d)))
