"""The entities that operators work on, as views of the input tables (declared columns only, so scans are pruned)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages: page_id, url, html, host, product (the host's label after 'example.')."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    return read(spark, sf_dir, "pages").select("page_id", "url", "html", host.alias("host"), F.regexp_extract(host, r"example\.([a-z]+)", 1).alias("product"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature catalogue rows: product, name, category, description, confidence 0 to 1, ord."""
    confidence = F.least(F.greatest((F.col("p_retailprice") - 900) / 100, F.lit(0.0)), F.lit(1.0))
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("product"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        F.concat(F.col("p_name"), F.lit(" for "), F.col("p_type")).alias("description"), confidence.alias("confidence"), F.col("p_partkey").alias("ord"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("project"), F.col("n_regionkey").cast("long").alias("owner_id"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("keyword_id"), F.col("c_nationkey").cast("long").alias("project_id"), F.col("c_name").alias("keyword"), F.col("c_mktsegment").alias("category"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict rows: analysis_id, keyword_id, status (O, △, X), confidence, analyzed_at."""
    status = F.when(F.col("o_orderstatus") == "O", "O").when(F.col("o_orderstatus") == "P", "△").otherwise("X")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("keyword_id"), status.alias("status"), (F.col("o_orderkey") % 100 / 100).alias("confidence"), F.col("o_orderdate").alias("analyzed_at")
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl and job feed: event_id, ts, job_id, domain, status, latency, ok."""
    status = F.when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), F.concat(F.lit("site"), F.col("user_id") % 50).alias("domain"), status.alias("status"), (F.col("value") / 100).alias("latency"), (F.col("event_type") != "error").alias("ok"), "props"
    )


#: The same views in SQL, for oracles.
SQL_VIEWS = {
    "pages_v": r"""SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(regexp_extract(url, '^https?://([^/?#:]+)', 1), 'example\.([a-z]+)', 1) AS product FROM pages""",
    "features_v": "SELECT p_brand AS product, p_name AS name, p_type AS category, p_name || ' for ' || p_type AS description, least(greatest((p_retailprice - 900) / 100, 0.0), 1.0) AS confidence, p_partkey AS ord FROM part",
    "projects_v": "SELECT CAST(n_nationkey AS BIGINT) AS project_id, n_name AS project, CAST(n_regionkey AS BIGINT) AS owner_id FROM nation",
    "keywords_v": "SELECT c_custkey AS keyword_id, CAST(c_nationkey AS BIGINT) AS project_id, c_name AS keyword, c_mktsegment AS category FROM customer",
    "analyses_v": "SELECT o_orderkey AS analysis_id, o_custkey AS keyword_id, CASE o_orderstatus WHEN 'O' THEN 'O' WHEN 'P' THEN '△' ELSE 'X' END AS status, o_orderkey % 100 / 100.0::DOUBLE AS confidence, o_orderdate AS analyzed_at FROM orders",
    "events_v": "SELECT event_id, ts, user_id AS job_id, 'site' || (user_id % 50) AS domain, CASE WHEN event_type IN ('view', 'click') THEN 'running' WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status, value / 100 AS latency, event_type <> 'error' AS ok, props FROM events",
}


def with_views(sql: str) -> str:
    """Prefix the views that a query names."""
    used = [f"{v} AS ({body})" for v, body in SQL_VIEWS.items() if v in sql]
    if not used:
        return sql
    head = "WITH RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    body = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return head + ", ".join(used) + ", " + body[len(start) :]
    return head + ", ".join(used) + " " + body
