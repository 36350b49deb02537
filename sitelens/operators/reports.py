"""Report tables over projects, keywords, verdicts and crawl results.  Small dimensions join by broadcast when Spark's size check allows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("O", "△", "X")


def count_where(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def crawl_status(results: DataFrame, by: str) -> DataFrame:
    """Per group: total and one count for each crawl status, in one pass."""
    return results.groupBy(by).agg(F.count("*").alias("total"), *(count_where(F.col("status") == s, s) for s in ("completed", "running", "failed", "pending")))


def support_counts(analyses: DataFrame, *by: str) -> DataFrame:
    """Counts of O, partial and X verdicts and their total."""
    return analyses.groupBy(*by).agg(
        F.count("*").alias("total"), count_where(F.col("status") == "O", "n_supported"), count_where(F.col("status") == "△", "n_partial"), count_where(F.col("status") == "X", "n_unsupported")
    )


def keyword_matrix(keywords: DataFrame, analyses: DataFrame) -> DataFrame:
    """Keyword by status counts and support rate; verdicts are aggregated before the join, keywords without any are kept."""
    counts = support_counts(analyses, "keyword_id")
    names = ["n_supported", "n_partial", "n_unsupported", "total"]
    out = keywords.join(counts, "keyword_id", "left").select("keyword_id", "keyword", "category", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return out.withColumn("support_rate", F.when(F.col("total") > 0, F.round(F.col("n_supported") / F.col("total"), 6)).otherwise(F.lit(0.0)))


def latest_analyses(analyses: DataFrame, keywords: DataFrame, n: int = 10, missing: str = "알 수 없음") -> DataFrame:
    """The n newest verdicts with keyword text; sorted and cut before the join."""
    newest = analyses.orderBy(F.desc("analyzed_at"), F.desc("analysis_id")).limit(n)
    return newest.join(keywords.select("keyword_id", "keyword"), "keyword_id", "left").select(
        "analysis_id", F.coalesce("keyword", F.lit(missing)).alias("keyword"), "status", F.format_number("confidence", 2).alias("confidence"), F.date_format("analyzed_at", "yyyy-MM-dd HH:mm:ss").alias("analyzed_at")
    )


def page_boundaries(rows: DataFrame, sort: str, key: str, per_page: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(page, sort, key, total): the first row of each page in descending order of (sort, key), made once for jumps to any page.

    Only the two columns are sorted: in ranges over tasks, which are then numbered from their counts.
    """
    order = [F.desc(sort), F.desc(key)]
    keys = keep(rows.select(sort, key).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = keys.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each task
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("before") - 1
    placed = keys.join(F.broadcast(before), "__part").withColumn("place", place)
    return keep(placed.filter(F.col("place") % per_page == 0).select((F.col("place") / per_page + 1).cast("long").alias("page"), sort, key, "total"))


def page_of(rows: DataFrame, sort: str, key: str, boundaries: DataFrame, page: int, per_page: int) -> DataFrame:
    """One page of a table sorted by (sort, key) descending, with row_no, total and the number of pages.

    The page lies between its boundary and the next one; both reach the scan as filters, so any page reads as much as the first.
    """
    ends = {r["page"]: r for r in boundaries.filter(F.col("page").between(page, page + 1)).collect()}
    if page not in ends:
        none = rows.limit(0)
        return none.withColumns({"row_no": F.lit(0).cast("long"), "total": F.lit(0).cast("long"), "n_pages": F.lit(0).cast("long")})
    first = ends[page]
    inside = (F.col(sort) < first[sort]) | ((F.col(sort) == first[sort]) & (F.col(key) <= first[key]))
    inside = inside & (F.col(sort) <= first[sort])
    if page + 1 in ends:
        after = ends[page + 1]
        inside = inside & (F.col(sort) >= after[sort]) & ((F.col(sort) > after[sort]) | (F.col(key) > after[key]))
    row_no = F.row_number().over(Window.orderBy(F.desc(sort), F.desc(key))) + (page - 1) * per_page  # per_page rows
    return rows.filter(inside).withColumns({"row_no": row_no.cast("long"), "total": F.lit(first["total"]), "n_pages": F.lit(-(-first["total"] // per_page))})


def next_page(rows: DataFrame, sort: str, key: str, after: tuple | None, per_page: int) -> DataFrame:
    """The page that follows the row (sort, key) of the last one seen, or the first page."""
    if after is not None:
        rows = rows.filter((F.col(sort) <= after[0]) & ((F.col(sort) < after[0]) | (F.col(key) < after[1])))
    return rows.orderBy(F.desc(sort), F.desc(key)).limit(per_page)


def category_statistics(features: DataFrame) -> DataFrame:
    return features.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def overall_confidence(features: DataFrame) -> DataFrame:
    """Count and mean confidence, 0 when empty."""
    return features.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"))


def project_list(projects: DataFrame, keywords: DataFrame, analyses: DataFrame) -> DataFrame:
    """Projects with counts of keywords and verdicts: each detail aggregated before its join, so nothing fans out."""
    per_keyword = analyses.groupBy("keyword_id").agg(F.count("*").alias("n"))
    by_project = keywords.join(per_keyword, "keyword_id", "left").groupBy("project_id").agg(F.count("*").alias("n_keywords"), F.sum(F.coalesce("n", F.lit(0))).alias("n_analyses"))
    return projects.join(by_project, "project_id", "left").select("project_id", "project", F.coalesce("n_keywords", F.lit(0)).alias("n_keywords"), F.coalesce("n_analyses", F.lit(0)).alias("n_analyses"))


def dashboard(project_rows: DataFrame) -> DataFrame:
    return project_rows.agg(F.count("*").alias("n_projects"), F.sum("n_keywords").alias("n_keywords"), F.sum("n_analyses").alias("n_analyses"))


def newest_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("row_no") <= n)


def owned(keywords: DataFrame, projects: DataFrame, owner_id: int) -> DataFrame:
    return keywords.join(projects.filter(F.col("owner_id") == owner_id), "project_id", "left_semi")


def product_cards(products: DataFrame, features: DataFrame) -> DataFrame:
    """O with the number of features, X for a product without any; first three categories and five names by order."""
    first = lambda column, n: F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", column))), lambda s: s[column]), 1, n)
    categories = features.groupBy("product", "category").agg(F.min("ord").alias("first")).groupBy("product").agg(F.array_join(first("category", 3), ", ").alias("categories"))
    top = newest_per_group(features, "product", [F.col("ord")], 5).groupBy("product").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "name"))), lambda s: s["name"]), ", ").alias("names"))
    counts = features.groupBy("product").agg(F.count("*").alias("n_features"))
    out = products.join(counts, "product", "left").join(categories, "product", "left").join(top, "product", "left")
    return out.select("product", F.when(F.col("n_features") > 0, "O").otherwise("X").alias("status"), F.coalesce("n_features", F.lit(0)).alias("n_features"), F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("names", F.lit("")).alias("names"))


def report_content(project_rows: DataFrame, analyses: DataFrame, matrix: DataFrame) -> DataFrame:
    """A report's sections as (section, item, value) rows."""
    info = project_rows.select(F.lit("project").alias("section"), F.col("project").alias("item"), F.col("n_keywords").alias("value"))
    stats = support_counts(analyses).select(F.lit("statistics").alias("section"), F.expr("stack(4, 'total', total, 'O', n_supported, '△', n_partial, 'X', n_unsupported) AS (item, value)"))
    cells = matrix.groupBy("category").agg(F.sum("n_supported").alias("value")).select(F.lit("matrix").alias("section"), F.col("category").alias("item"), "value")
    return info.unionByName(stats).unionByName(cells)
