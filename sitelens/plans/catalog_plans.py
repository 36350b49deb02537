"""Feature-catalogue queries.  Two products stand for 'left' and 'right' where two are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources import tables as S
from ..sources import files as X
from ..sources.materialise import written
from ..operators import pages as P
from .page_plans import LINKS
from .registry import query

A, B = "Brand#11", "Brand#22"
CATEGORIES = ["ECONOMY", "STANDARD"]
NORM = r"trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
MERGED = f"SELECT product, {NORM} AS norm, count(*) AS n_merged, arg_max(struct_pack(name := name, category := category, description := description, confidence := confidence, ord := ord), (confidence, length(description), -ord)) AS best FROM features_v GROUP BY 1, 2"
ALL_MERGED = f"SELECT {NORM} AS norm, count(*) AS n_merged, arg_max(struct_pack(product := product, name := name, confidence := confidence), (confidence, length(description), -ord)) AS best FROM features_v GROUP BY 1"
SIDES = f"SELECT coalesce(a.norm, b.norm) AS norm, a.norm IS NOT NULL AS in_1, b.norm IS NOT NULL AS in_2, coalesce(a.best.description, '') AS description_1, coalesce(b.best.description, '') AS description_2, coalesce('https://example.com/' || a.best.ord, '') AS url_1, coalesce('https://example.com/' || b.best.ord, '') AS url_2 FROM (SELECT * FROM ({MERGED}) WHERE product = (SELECT min(product) FROM features_v)) a FULL JOIN (SELECT * FROM ({MERGED}) WHERE product = (SELECT max(product) FROM features_v)) b ON a.norm = b.norm"
CELLS = f"SELECT p.product, n.norm, CASE WHEN h.norm IS NULL THEN 'X' ELSE 'O' END AS status FROM (SELECT DISTINCT norm FROM ({MERGED})) n CROSS JOIN (SELECT DISTINCT product FROM features_v) p LEFT JOIN (SELECT DISTINCT product, norm FROM ({MERGED})) h ON h.product = p.product AND h.norm = n.norm"


def merged(spark, d):
    return C.merge_best(S.features(spark, d), "product")


def two(spark, d):
    rows = merged(spark, d).withColumn("url", F.concat(F.lit("https://example.com/"), "ord"))
    ends = S.features(spark, d).agg(F.min("product").alias("a"), F.max("product").alias("b"))
    side = lambda c: rows.join(F.broadcast(ends.select(F.col(c).alias("product"))), "product", "left_semi")
    return side("a"), side("b")


def matrix(spark, d):
    rows = merged(spark, d)
    return C.support_matrix(rows, rows.select("product").distinct(), rows.select("norm").distinct())


def n_products(spark, d):
    return S.features(spark, d).select("product").distinct().count()


def messy(spark, d):
    """Catalogue rows with faults at known places, from the part table."""
    f = S.features(spark, d)
    return f.select("ord", "product", F.when(F.col("ord") % 7 == 0, F.lit("  ")).when(F.col("ord") % 11 == 0, None).otherwise(F.concat(F.lit(" "), "name")).alias("name"), F.when(F.col("ord") % 5 == 0, None).otherwise(F.split("category", " ")[0]).alias("category"), F.when(F.col("ord") % 13 == 0, F.repeat(F.concat("description", F.lit(" ")), 40)).otherwise(F.col("description")).alias("description"), (F.col("confidence") * F.when(F.col("ord") % 3 == 0, 2.0).otherwise(1.0)).alias("confidence"))


MESSY = "SELECT ord, product, CASE WHEN ord % 7 = 0 THEN '  ' WHEN ord % 11 = 0 THEN NULL ELSE ' ' || name END AS name, CASE WHEN ord % 5 = 0 THEN NULL ELSE split_part(category, ' ', 1) END AS category, CASE WHEN ord % 13 = 0 THEN repeat(description || ' ', 40) ELSE description END AS description, confidence * CASE WHEN ord % 3 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM features_v"
VALID = "coalesce(name IS NOT NULL AND category IS NOT NULL AND description IS NOT NULL AND length(trim(name)) BETWEEN 3 AND 100, false)"


@query("cat1_validate", f"SELECT ord, product, trim(name) AS name, CASE WHEN category IN ('ECONOMY', 'STANDARD') THEN category ELSE '기타' END AS category, CASE WHEN length(trim(description)) > 500 THEN substr(trim(description), 1, 497) || '...' ELSE trim(description) END AS description, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.5 END AS confidence FROM ({MESSY}) WHERE {VALID}")
def cat1(spark, d):
    return C.validate(messy(spark, d), CATEGORIES)[0]


@query("cat1_rejected", f"SELECT ord, product FROM ({MESSY}) WHERE NOT {VALID}")
def cat1_rejected(spark, d):
    return C.validate(messy(spark, d), CATEGORIES)[1].select("ord", "product")


@query("cat2_clean_lenient", f"SELECT ord, product, name, coalesce(category, '기타') AS category, coalesce(description, name) AS description, least(greatest(coalesce(confidence, 0.8), 0.0), 1.0) AS confidence, CAST(row_no AS BIGINT) AS row_no FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ord) AS row_no FROM ({MESSY}) WHERE length(trim(name)) > 0) WHERE row_no <= 20")
def cat2(spark, d):
    return C.clean_lenient(messy(spark, d)).withColumn("row_no", F.col("row_no").cast("long"))


@query("cat3_validate_comparisons", "SELECT event_id AS row_id, 'f' || (user_id % 20) AS feature_name, user_id % 2 = 0 AS product1_support, false AS product2_support, CASE WHEN event_type = 'view' THEN 'unique_product1' ELSE 'common' END AS comparison_type, CASE WHEN value / 200 BETWEEN 0 AND 1 THEN value / 200 ELSE 0.5 END AS similarity_score FROM events WHERE user_id % 17 <> 0")
def cat3(spark, d):
    e = S.read(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "unique_product1").otherwise(F.col("event_type"))
    name = F.when(F.col("user_id") % 17 == 0, "f").otherwise(F.concat(F.lit("f"), F.col("user_id") % 20))
    body = F.to_json(F.struct(name.alias("feature_name"), (F.col("user_id") % 2 == 0).alias("product1_support"), kind.alias("comparison_type"), (F.col("value") / 200).alias("similarity_score")))
    return C.validate_comparisons(e.select(F.col("event_id").alias("row_id"), body.alias("body")))


@query("cat4_normalised_names", f"SELECT ord, {NORM} AS norm FROM features_v")
def cat4(spark, d):
    return S.features(spark, d).select("ord", C.normalised_name(F.col("name")).alias("norm"))


@query("cat5_merge_best", f"SELECT product, norm, CAST(n_merged AS BIGINT) AS n_merged, best.name AS name, best.category AS category, best.description AS description, best.confidence AS confidence, best.ord AS ord FROM ({MERGED})")
def cat5(spark, d):
    return merged(spark, d)


@query("cat6_keep_first", "SELECT product, name, ord FROM (SELECT *, row_number() OVER (PARTITION BY product, lower(trim(name)) ORDER BY ord) AS r FROM features_v) WHERE r = 1")
def cat6(spark, d):
    return C.keep_first(S.features(spark, d), "product").select("product", "name", "ord")


@query("cat7_union_tagged", "SELECT 'first' AS product, name, ord FROM features_v WHERE product < 'Brand#3' UNION ALL SELECT 'second', name, ord FROM features_v WHERE product >= 'Brand#3'")
def cat7(spark, d):
    f = S.features(spark, d)
    return C.union_tagged({"first": f.filter("product < 'Brand#3'").drop("product"), "second": f.filter("product >= 'Brand#3'").drop("product")}).select("product", "name", "ord")


@query("cat8_flattened_page_features", r"SELECT page_id, url, CAST(i AS BIGINT) AS ord, regexp_extract(h, '>([^<]*)<', 1) AS name FROM (SELECT page_id, url, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<h[1-6][^>]*>[^<]*<') AS hs FROM pages))")
def cat8(spark, d):
    names = F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>[^<]*<"), F.lit(0))
    return S.pages(spark, d).select("page_id", "url", F.posexplode(names).alias("ord", "h")).select("page_id", "url", F.col("ord").cast("long").alias("ord"), F.regexp_extract("h", ">([^<]*)<", 1).alias("name"))


@query("cat9_compare_two", SIDES)
def cat9(spark, d):
    return C.compare_two(*two(spark, d))


@query("cat9_comparison_counts", f"SELECT CAST(count_if(in_1 AND in_2) AS BIGINT) AS common, CAST(count_if(in_1 AND NOT in_2) AS BIGINT) AS unique_p1, CAST(count_if(NOT in_1 AND in_2) AS BIGINT) AS unique_p2 FROM ({SIDES})")
def cat9_counts(spark, d):
    return C.comparison_counts(C.compare_two(*two(spark, d)))


@query("cat10_category_algebra", "SELECT coalesce(a.category, b.category) AS category, CASE WHEN b.category IS NULL THEN 'left' WHEN a.category IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT category || ' ' || name AS category FROM features_v WHERE product < 'Brand#3') a FULL JOIN (SELECT DISTINCT category || ' ' || name AS category FROM features_v WHERE product >= 'Brand#3') b ON a.category = b.category")
def cat10(spark, d):
    """All features in two sides by product; kind and name together are fine categories, so that either side has some of its own."""
    f = S.features(spark, d).withColumn("category", F.concat_ws(" ", "category", "name"))
    return C.category_algebra(f.filter("product < 'Brand#3'"), f.filter("product >= 'Brand#3'"))


@query("cat11_common_to_all", f"SELECT norm FROM (SELECT DISTINCT product, norm FROM ({MERGED})) GROUP BY norm HAVING count(*) = (SELECT count(DISTINCT product) FROM features_v)")
def cat11(spark, d):
    return C.common_to_all(matrix(spark, d), n_products(spark, d))


@query("cat12_advantages", f"SELECT min(product) AS product, norm FROM (SELECT DISTINCT product, norm FROM ({MERGED})) GROUP BY norm HAVING count(*) = 1")
def cat12(spark, d):
    return C.advantages(matrix(spark, d))


SUMMARY = f"SELECT product, CAST(count(*) AS BIGINT) AS total, CAST(count_if(n = (SELECT count(DISTINCT product) FROM features_v)) AS BIGINT) AS common, CAST(count_if(n = 1) AS BIGINT) AS unique_count, CAST(count(*) - count_if(n = (SELECT count(DISTINCT product) FROM features_v)) AS BIGINT) AS count_minus_common FROM (SELECT *, count(*) OVER (PARTITION BY norm) AS n FROM (SELECT DISTINCT product, norm FROM ({MERGED}))) GROUP BY product"
ADVICE = f"SELECT product, 'unique' AS rule, printf('%s has %d features of its own to set it apart', product, unique_count) AS advice FROM ({SUMMARY}) WHERE unique_count > 0 UNION ALL SELECT product, 'common', printf('%s shares %d features: improve their use', product, common) FROM ({SUMMARY}) WHERE common > 0"


def summary(spark, d):
    return C.comparison_summary(matrix(spark, d), n_products(spark, d))


@query("cat13_comparison_summary", SUMMARY)
def cat13(spark, d):
    return summary(spark, d)


@query("cat14_recommendations", ADVICE)
def cat14(spark, d):
    return C.recommendations(summary(spark, d))


MAPPED = f"SELECT norm, CASE WHEN in_1 AND in_2 THEN 'common' WHEN in_1 THEN 'unique_product1' ELSE 'unique_product2' END AS comparison_type, CASE WHEN in_1 THEN 'O' ELSE 'X' END AS status_1, CASE WHEN in_2 THEN 'O' ELSE 'X' END AS status_2, CASE WHEN in_1 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence_1, CASE WHEN in_2 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence_2, CASE WHEN in_1 AND in_2 THEN 0.85::DOUBLE ELSE 0.25::DOUBLE END AS similarity FROM ({SIDES})"


@query("cat15_side_by_side", MAPPED)
def cat15(spark, d):
    return C.side_by_side(C.compare_two(*two(spark, d)))


@query("cat16_comparison_table", f"SELECT comparison_type, coalesce(category, '(all)') AS category, CAST(count(*) AS BIGINT) AS n FROM (SELECT comparison_type, split_part(norm, ' ', 1) AS category FROM ({MAPPED})) GROUP BY ROLLUP (comparison_type, category) HAVING comparison_type IS NOT NULL")
def cat16(spark, d):
    mapped = C.side_by_side(C.compare_two(*two(spark, d)))
    return C.comparison_table(mapped.withColumn("category", F.split("norm", " ")[0]))


@query("cat17_category_digest", "SELECT category, string_agg(name, ', ' ORDER BY ord) FILTER (r <= 5) || CASE WHEN count(*) > 5 THEN ' 외 ' || (count(*) - 5) || '개' ELSE '' END AS line FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS r FROM features_v) GROUP BY category")
def cat17(spark, d):
    return C.category_digest(S.features(spark, d))


@query("cat18_executive_summary", f"SELECT c.*, i.insights FROM (SELECT CAST(count_if(in_1 AND in_2) AS BIGINT) AS common, CAST(count_if(in_1 AND NOT in_2) AS BIGINT) AS unique_p1, CAST(count_if(NOT in_1 AND in_2) AS BIGINT) AS unique_p2 FROM ({SIDES})) c CROSS JOIN (SELECT coalesce(string_agg(advice, ' | ' ORDER BY advice), '') AS insights FROM (SELECT advice FROM ({ADVICE}) ORDER BY product, rule LIMIT 3)) i")
def cat18(spark, d):
    return C.executive_summary(C.comparison_counts(C.compare_two(*two(spark, d))), C.recommendations(summary(spark, d)))


@query("cat19_catalogue_summary", "SELECT category, CAST(count(*) AS BIGINT) AS total, CAST(count_if(confidence >= 0.8) AS BIGINT) AS high, round(avg(confidence), 6) AS avg_confidence FROM features_v GROUP BY category")
def cat19(spark, d):
    return C.catalogue_summary(S.features(spark, d))


@query("cat20_quality_bucket", "SELECT host, CAST(count(*) AS BIGINT) AS n_pages, CASE WHEN count(*) = 0 THEN 'low' WHEN count(*) < 5 THEN 'medium' ELSE 'high' END AS quality FROM pages_v GROUP BY host")
def cat20(spark, d):
    return S.pages(spark, d).groupBy("host").agg(F.count("*").alias("n_pages")).withColumn("quality", C.quality_bucket(F.col("n_pages")))


@query("cat21_assemble_corpus", "SELECT product, substr(string_agg(block, chr(10) ORDER BY ord), 1, 8000) AS corpus, CAST(count(*) AS BIGINT) AS n_blocks FROM (SELECT *, coalesce(sum(length(block) + 1) OVER (PARTITION BY product ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT host AS product, page_id AS ord, '[' || url || '] ' || substr(html, 1, 300) AS block FROM pages_v)) WHERE before < 8000 GROUP BY product")
def cat21(spark, d):
    p = S.pages(spark, d).select(F.col("host").alias("product"), F.col("page_id").alias("ord"), F.col("url").alias("title"), F.col("html").alias("content"))
    return C.assemble_corpus(p)


@query("cat21_corpus_with_links", f"WITH l AS ({LINKS}), t AS (SELECT page_id, string_agg(text, ', ' ORDER BY ord) AS link_texts FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS r FROM l) WHERE r <= 10 GROUP BY page_id) SELECT product, substr(string_agg(block, chr(10) ORDER BY ord), 1, 8000) AS corpus, CAST(count(*) AS BIGINT) AS n_blocks FROM (SELECT *, coalesce(sum(length(block) + 1) OVER (PARTITION BY product ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT p.host AS product, p.page_id AS ord, '[' || p.url || '] ' || substr(p.html, 1, 300) || coalesce(' links: ' || link_texts, '') AS block FROM pages_v p LEFT JOIN t USING (page_id))) WHERE before < 8000 GROUP BY product")
def cat21_links(spark, d):
    p = S.pages(spark, d)
    texts = P.links(p).select(F.col("page_id").alias("ord"), F.col("ord").alias("place"), "text")
    rows = p.select(F.col("host").alias("product"), F.col("page_id").alias("ord"), F.col("url").alias("title"), F.col("html").alias("content"))
    return C.assemble_corpus(rows, links=texts)


@query("cat22_named_products", "SELECT ord, CASE WHEN blank THEN 'product' || r ELSE product END AS product FROM (SELECT CAST(n_nationkey AS BIGINT) AS ord, n_name AS product, n_nationkey % 4 = 1 AS blank, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation)")
def cat22(spark, d):
    rows = S.projects(spark, d).select(F.col("project_id").alias("ord"), F.when(F.col("project_id") % 4 == 1, F.lit("  ")).otherwise(F.col("project")).alias("product"))
    return C.named_products(rows, written)


@query("cat23_run_summary", "SELECT (SELECT count(*) FROM pages) AS n_pages, (SELECT count(DISTINCT product) FROM features_v) AS n_products, (SELECT count(DISTINCT lower(trim(name))) FROM features_v) AS n_unique_features, (SELECT CAST(epoch(max(ts)) - epoch(min(ts)) AS DOUBLE) FROM events) AS elapsed_s")
def cat23(spark, d):
    f, e = S.features(spark, d), S.job_events(spark, d)
    one = S.pages(spark, d).agg(F.count("*").alias("n_pages"))
    two_ = f.agg(F.countDistinct("product").alias("n_products"), F.countDistinct(F.lower(F.trim("name"))).alias("n_unique_features"))
    three = e.agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("elapsed_s"))
    return one.crossJoin(two_).crossJoin(three)


@query("cat24_placeholders", "SELECT p.product, CAST(coalesce(f.n, 0) AS BIGINT) AS n_features, CAST(coalesce(g.n, 0) AS BIGINT) AS n_pages, CASE WHEN coalesce(g.n, 0) = 0 THEN 'low' WHEN g.n < 5 THEN 'medium' ELSE 'high' END AS quality FROM (SELECT unnest(['com', 'net', 'org', 'app']) AS product) p LEFT JOIN (SELECT CASE ord % 4 WHEN 0 THEN 'com' WHEN 1 THEN 'net' WHEN 2 THEN 'org' ELSE 'none' END AS product, count(*) AS n FROM features_v GROUP BY 1) f USING (product) LEFT JOIN (SELECT product, count(*) AS n FROM pages_v GROUP BY 1) g USING (product)")
def cat24(spark, d):
    products = spark.createDataFrame([("com",), ("net",), ("org",), ("app",)], "product string")
    where = F.when(F.col("ord") % 4 == 0, "com").when(F.col("ord") % 4 == 1, "net").when(F.col("ord") % 4 == 2, "org").otherwise("none")
    return C.with_placeholders(products, S.features(spark, d).withColumn("product", where), S.pages(spark, d))


#: Part numbers that the features of one reply are taken from.
KEYS_A_REPLY = 10_000


@query("cat25_parents_and_children", "SELECT product AS analysis, CAST(count(*) AS BIGINT) AS n_features, min(name) AS first_name, max(confidence) AS best FROM features_v GROUP BY product")
def cat25(spark, d):
    """Replies of each product with its features, of a range of part numbers each so that no reply grows with the table; each is parsed
    and kept as a parent row and children that its key links."""
    item = F.struct("name", "category", "description", "confidence", "product")
    text = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.collect_list(item).alias("extracted_features"))), F.lit("\n```"))
    replies = S.features(spark, d).groupBy("product", F.floor(F.col("ord") / KEYS_A_REPLY).alias("range")).agg(text.alias("text")).select(F.col("product").alias("reply_id"), "text")
    parents, children = X.persisted(written(X.parse_replies(replies)[0]))
    first = children.groupBy("analysis_id").agg(F.min("name").alias("first_name"), F.max("confidence").alias("best"))
    # replies of equal features have one key: each is a parent row, and what is first or best is the same for both
    whole = parents.join(first, "analysis_id").groupBy(F.col("reply_id").alias("analysis"))
    return whole.agg(F.sum("n_features").cast("long").alias("n_features"), F.min("first_name").alias("first_name"), F.max("best").alias("best"))
