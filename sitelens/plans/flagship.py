"""The whole way from captured pages to a support matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators import scoring
from ..sources import tables as S
from .page_plans import TAGS, TEXT
from ..sources.materialise import sized
from .registry import query
from .scoring_plans import KEYS, KEYWORDS, SUPPORT, WORDS, keywords

PAGE_SUPPORT = SUPPORT.replace("FROM documents)", f"FROM (SELECT page_id AS doc_id, {TEXT} AS text FROM pages))")


@query("flagship_support_matrix", f"SELECT product, keyword, CAST(count_if(status = 'O') AS BIGINT) AS n_supported, CAST(count_if(status = '△') AS BIGINT) AS n_partial, CAST(count_if(status = 'X') AS BIGINT) AS n_unsupported FROM ({PAGE_SUPPORT}) JOIN pages_v ON page_id = doc_id GROUP BY product, keyword")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to text, text to verdicts for each keyword, verdicts to counts by product: one shuffle of small partial counts."""
    text = S.pages(spark, sf_dir).select("page_id", "product", F.lit(0).alias("project_id"), P.plain_text(F.col("html"), TAGS).alias("content"))
    asked = scoring.with_tokens(text).join(sized(keywords(spark)), "project_id")
    verdicts = asked.select("product", "keyword", scoring.keyword_support(F.col("keyword"), F.col("__low"), tokens=F.col("__tokens"))["status"].alias("status"))
    return verdicts.groupBy("product", "keyword").agg(F.count_if(F.col("status") == "O").alias("n_supported"), F.count_if(F.col("status") == "△").alias("n_partial"), F.count_if(F.col("status") == "X").alias("n_unsupported"))


@query("src6_table_round_trip", "SELECT keyword_id, project_id, keyword, category FROM keywords_v")
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords saved as a table partitioned by project in the shared folder, and read again."""
    import uuid

    from ..sources import files
    from ..sources.materialise import shared_folder

    rows, name = S.keywords(spark, sf_dir), f"keywords_{uuid.uuid4().hex}"
    files.save_by_project(rows, name, f"{shared_folder(spark)}/{name}")
    return spark.table(name).select("keyword_id", "project_id", "keyword", "category")
