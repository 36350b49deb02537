"""Files in and out: keyword CSV, crawl results, model replies, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .materialise import discard, written

REPLY_SCHEMA = "extracted_features ARRAY<STRUCT<name STRING, category STRING, description STRING, confidence DOUBLE, granularity STRING, product STRING>>, analysis_summary STRUCT<total_features INT, main_categories ARRAY<STRING>, document_quality STRING>"


#: Quotes are doubled; a quoted empty field is an empty text, an empty one nothing.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
READ_CSV = CSV | {"nullValue": "\u0001"}
#: Whether an overwrite replaces the whole table or the parts that it has rows for.
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, category, ord): the lines of a CSV file, or of a folder of them by project (then with project_id); ord is their order."""
    rows = spark.read.options(**READ_CSV).schema("keyword STRING, category STRING").csv(path)
    return rows.withColumn("ord", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")))


def import_keywords(spark: SparkSession, path: str, existing: DataFrame) -> DataFrame:
    """New rows (project_id, keyword, category) of a folder of keyword files by project; their count is the import's created_count."""
    return new_keywords(read_keywords(spark, path), existing).select("project_id", "keyword", "category")


def new_keywords(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (project_id, ord, keyword, category) not blank, first of each keyword, and not there already; case counts."""
    trimmed = rows.withColumn("keyword", F.trim("keyword")).filter(F.length("keyword") > 0)
    first = trimmed.groupBy("project_id", "keyword").agg(F.min_by("category", "ord").alias("category"), F.min("ord").alias("ord"))
    return first.join(existing.select("project_id", "keyword").distinct(), ["project_id", "keyword"], "left_anti")


def export_keywords(keywords: DataFrame) -> DataFrame:
    return keywords.select("keyword", F.coalesce("category", F.lit("")).alias("category"))


def crawl_document(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, one row of statistics) of a crawl (title, url, content[, depth, source])."""
    own = [F.col("depth") if "depth" in pages.columns else F.lit(0).alias("depth"), F.col("source") if "source" in pages.columns else F.lit("initial").alias("source")]
    results = pages.select("title", "url", "content", *own, F.length("content").cast("long").alias("content_length"))
    return results, results.agg(F.count("*").alias("total_pages"), F.count_if(F.length("content") > 0).alias("successful_pages"), F.sum("content_length").alias("n_chars"))


def export_crawl(pages: DataFrame, folder: str, config: dict) -> None:
    """A crawl in a folder: results and statistics with the configuration as JSON lines, and the CSV form with its five columns."""
    results, statistics = crawl_document(pages)
    results.write.mode("overwrite").json(f"{folder}/results")
    statistics.withColumn("config", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(config.items())]))).write.mode("overwrite").json(f"{folder}/statistics")
    write_csv(results.select("title", "url", "depth", "source", "content_length"), f"{folder}/csv")


def read_crawl(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, statistics, rows of the CSV form) of an exported crawl."""
    results = spark.read.schema("title STRING, url STRING, content STRING, depth INT, source STRING, content_length LONG").json(f"{folder}/results")
    statistics = spark.read.schema("total_pages LONG, successful_pages LONG, n_chars LONG, config STRING").json(f"{folder}/statistics")
    return results, statistics, spark.read.options(**READ_CSV, multiLine=True).schema("title STRING, url STRING, depth INT, source STRING, content_length LONG").csv(f"{folder}/csv")


def write_csv(rows: DataFrame, path: str, by: str | None = None) -> None:
    """CSV files with a header; by: a folder for each value of a column, in the order of the rows given."""
    out = rows.write.options(**CSV).mode("overwrite")
    (out.partitionBy(by) if by else out).csv(path)


def analysis_report(analyses: DataFrame, keywords: DataFrame) -> DataFrame:
    """Verdicts with their keyword (rows without one dropped), blanks filled, time formatted."""
    return analyses.join(keywords.select("keyword_id", "keyword", "category"), "keyword_id").select(
        "analysis_id", "keyword", F.coalesce("category", F.lit("")).alias("category"), "status", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.date_format("analyzed_at", "yyyy-MM-dd HH:mm:ss").alias("analyzed_at")
    )


def save_by_project(rows: DataFrame, table: str, path: str) -> None:
    """A table in a folder of its own, a part for each project; rows of a project are dealt together, so a part has few files."""
    rows.repartition("project_id").write.partitionBy("project_id").mode("overwrite").option("path", path).saveAsTable(table)


def purge_project(spark: SparkSession, table: str, project_id: int, rows: Column | None = None) -> int:
    """Deletes a project's rows, or those of them that `rows` holds for, from a table of save_by_project; how many went.

    What stays of the project is written over its own part only (dynamic partition overwrite); files of other projects stay as
    they are.  A part without rows is dropped with its folder.
    """
    own = spark.table(table).filter(F.col("project_id") == project_id)
    gone = F.lit(True) if rows is None else F.coalesce(rows, F.lit(False))
    counts = own.agg(F.count_if(gone).alias("gone"), F.count("*").alias("all")).first()
    if counts["gone"] and counts["gone"] < counts["all"]:
        left = written(own.filter(~gone))  # a table can't be overwritten while it is read
        before = spark.conf.get(OVERWRITE)
        spark.conf.set(OVERWRITE, "dynamic")
        try:
            left.write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set(OVERWRITE, before)
        discard(left)
    elif counts["gone"]:
        place = spark.sql(f"DESCRIBE FORMATTED {table} PARTITION (project_id = {int(project_id)})").filter("col_name = 'Location'").first()["data_type"]
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (project_id = {int(project_id)})")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return counts["gone"]


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table, read in ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def reply_body(text: Column) -> Column:
    """A fenced json block, else any fence that begins an object, else the outermost braces, else the text."""
    got = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return F.coalesce(got(r"(?s)```json\s*(.*?)(?:```|$)"), got(r"(?s)```\s*(\{.*?)(?:```|$)"), got(r"(?s)(\{.*\})"), text)


def parse_replies(replies: DataFrame, schema: str = REPLY_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, error rows with the first 1000 characters) of (reply_id, text)."""
    body = replies.withColumn("body", reply_body(F.col("text"))).withColumn("ok", F.try_parse_json("body").isNotNull())
    return body.filter("ok").select("reply_id", "body", F.from_json("body", schema).alias("parsed")), body.filter(~F.coalesce(F.col("ok"), F.lit(False))).select("reply_id", F.substring("text", 1, 1000).alias("error"))


def persisted(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One analysis row for each reply and its exploded features, linked by a key made from the reply."""
    key = F.xxhash64("reply_id", "body").alias("analysis_id")
    parent = parsed.select(key, "reply_id", F.size("parsed.extracted_features").alias("n_features"))
    return parent, parsed.select(key, F.explode("parsed.extracted_features").alias("f")).select("analysis_id", "f.*")


def nested_sitemaps(locs: DataFrame, roots: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Page locations reached from root sitemaps through index files, (url, loc, is_index) rows given.

    Goes on until no sitemap is new, so files of any depth, and such that name each other, are read once.  `keep` writes a step.
    """
    seen = at = keep(roots.select("url").distinct())
    while not at.isEmpty():
        nested = locs.filter("is_index").join(at, "url").select(F.col("loc").alias("url")).distinct()
        at = keep(nested.join(seen, "url", "left_anti"))
        seen = keep(seen.unionByName(at))
    return locs.filter(~F.col("is_index")).join(seen, "url").select("loc").distinct()


def numbered(rows: DataFrame, order: str) -> Column:
    return F.row_number().over(Window.partitionBy("project_id").orderBy(order))
