"""Feature catalogues: cleaning, deduplication, comparison of any number of products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.materialise import sized

OTHER = "기타"


def normalised_name(name: Column) -> Column:
    """Lower case, punctuation removed, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def is_valid(rows: DataFrame) -> Column:
    size = F.length(F.trim("name"))
    return F.coalesce(F.col("name").isNotNull() & F.col("category").isNotNull() & F.col("description").isNotNull() & size.between(3, 100), F.lit(False))


def validate(rows: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected rows): required fields, name length, known category, confidence in range, cut description."""
    confidence = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.lit(0.5))
    text = F.trim("description")
    clean = rows.filter(is_valid(rows)).select(
        *[c for c in rows.columns if c not in ("name", "category", "description", "confidence")],
        F.trim("name").alias("name"),
        F.when(F.col("category").isin(categories), F.col("category")).otherwise(OTHER).alias("category"),
        F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 497), F.lit("..."))).otherwise(text).alias("description"),
        confidence.alias("confidence"),
    )
    return clean, rows.filter(~is_valid(rows))


def clean_lenient(rows: DataFrame, per_source: int = 20) -> DataFrame:
    """Name required; category and description defaulted, confidence clamped (0.8 when missing), first rows of each product."""
    named = rows.filter(F.length(F.trim("name")) > 0)
    confidence = F.least(F.greatest(F.coalesce("confidence", F.lit(0.8)), F.lit(0.0)), F.lit(1.0))
    named = named.withColumns({"category": F.coalesce("category", F.lit(OTHER)), "confidence": confidence, "description": F.coalesce("description", "name")})
    return named.withColumn("row_no", F.row_number().over(Window.partitionBy("product").orderBy("ord"))).filter(F.col("row_no") <= per_source)


def validate_comparisons(rows: DataFrame) -> DataFrame:
    """Comparison rows (JSON text in `body`) with required fields, defaults and ranges."""
    v = F.try_parse_json("body")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    kind, score = get("$.comparison_type", "string"), get("$.similarity_score", "double")
    out = rows.select(
        "row_id", get("$.feature_name", "string").alias("feature_name"), F.coalesce(get("$.product1_support", "boolean"), F.lit(False)).alias("product1_support"),
        F.coalesce(get("$.product2_support", "boolean"), F.lit(False)).alias("product2_support"),
        F.when(kind.isin("common", "unique_product1", "unique_product2"), kind).otherwise("common").alias("comparison_type"),
        F.when(score.between(0, 1), score).otherwise(0.5).alias("similarity_score"),
    )
    return out.filter(F.length(F.trim("feature_name")) >= 2)


def merge_best(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each normalised name (within `by`): highest confidence, then longest description, then first."""
    key = normalised_name(F.col("name"))
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(F.col("confidence"), F.length("description"), -F.col("ord")))
    return rows.withColumn("norm", key).groupBy(*by, "norm").agg(best.alias("best"), F.count("*").alias("n_merged")).select(*by, "norm", "n_merged", "best.*")


def keep_first(rows: DataFrame, *by: str) -> DataFrame:
    """The first row, by order, of each lower-cased trimmed name."""
    return rows.withColumn("key", F.lower(F.trim("name"))).groupBy(*by, "key").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in by]), "ord").alias("best")).select(*by, "best.*")


def union_tagged(catalogues: dict[str, DataFrame]) -> DataFrame:
    """Catalogues of several products as one, tagged with the product."""
    out = None
    for product, rows in catalogues.items():
        tagged = rows.withColumn("product", F.lit(product))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def compare_two(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full comparison of two catalogues of distinct normalised names: who has each, and what either says of it and where."""
    side = lambda rows, n: rows.select("norm", *[F.col(c).alias(f"{c}_{n}") for c in ("name", "description", "url")])
    return side(left, 1).join(side(right, 2), "norm", "full_outer").select(
        "norm", F.col("name_1").isNotNull().alias("in_1"), F.col("name_2").isNotNull().alias("in_2"), F.coalesce("description_1", F.lit("")).alias("description_1"), F.coalesce("description_2", F.lit("")).alias("description_2"),
        F.coalesce("url_1", F.lit("")).alias("url_1"), F.coalesce("url_2", F.lit("")).alias("url_2"),
    )


def comparison_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_if(F.col("in_1") & F.col("in_2")).alias("common"), F.count_if(F.col("in_1") & ~F.col("in_2")).alias("unique_p1"), F.count_if(~F.col("in_1") & F.col("in_2")).alias("unique_p2"))


def category_algebra(left: DataFrame, right: DataFrame) -> DataFrame:
    """(category, side: both, left, right) of two catalogues."""
    a, b = left.select("category").distinct(), right.select("category").distinct()
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("left"))).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def support_matrix(rows: DataFrame, products: DataFrame, names: DataFrame) -> DataFrame:
    """Long matrix (product, norm, status): O where the product has the feature, else X.

    `products` is a small dimension and `names` a catalogue; every pair is a cell of the result.
    """
    has = rows.select("product", "norm").distinct().withColumn("has", F.lit(True))
    return names.crossJoin(sized(products)).join(has, ["product", "norm"], "left").select("product", "norm", F.when(F.col("has"), "O").otherwise("X").alias("status"))


def common_to_all(matrix: DataFrame, n_products: int) -> DataFrame:
    return matrix.groupBy("norm").agg(F.count_if(F.col("status") == "O").alias("n")).filter(F.col("n") == n_products).select("norm")


def advantages(matrix: DataFrame) -> DataFrame:
    """(product, norm) of features that exactly one product has."""
    only = matrix.filter(F.col("status") == "O").groupBy("norm").agg(F.count("*").alias("n"), F.min("product").alias("product"))
    return only.filter(F.col("n") == 1).select("product", "norm")


def comparison_summary(matrix: DataFrame, n_products: int) -> DataFrame:
    """For each product: features, those common to all, those of this product only, and features minus common."""
    held = matrix.filter(F.col("status") == "O").groupBy("norm").agg(F.collect_set("product").alias("products"))
    each = held.select(F.size("products").alias("n"), F.explode("products").alias("product"))
    out = each.groupBy("product").agg(F.count("*").alias("total"), F.count_if(F.col("n") == n_products).alias("common"), F.count_if(F.col("n") == 1).alias("unique_count"))
    return out.withColumn("count_minus_common", F.col("total") - F.col("common"))


def recommendations(summary: DataFrame) -> DataFrame:
    """One row for each rule that a product's counts meet."""
    unique = summary.filter(F.col("unique_count") > 0).select("product", F.lit("unique").alias("rule"), F.format_string("%s has %d features of its own to set it apart", "product", "unique_count").alias("advice"))
    common = summary.filter(F.col("common") > 0).select("product", F.lit("common").alias("rule"), F.format_string("%s shares %d features: improve their use", "product", "common").alias("advice"))
    return unique.unionByName(common)


def side_by_side(compared: DataFrame) -> DataFrame:
    """Mapping rows of two catalogues with status, confidence and similarity by type, best first."""
    kind = F.when(F.col("in_1") & F.col("in_2"), "common").when(F.col("in_1"), "unique_product1").otherwise("unique_product2")
    mark = lambda flag: F.when(F.col(flag), "O").otherwise("X")
    sure = lambda flag: F.when(F.col(flag), 0.9).otherwise(0.7)
    return compared.select("norm", kind.alias("comparison_type"), mark("in_1").alias("status_1"), mark("in_2").alias("status_2"), sure("in_1").alias("confidence_1"), sure("in_2").alias("confidence_2"), F.when(kind == "common", 0.85).otherwise(0.25).alias("similarity"))


def comparison_table(mapped: DataFrame) -> DataFrame:
    """Counts by category and comparison type with a grand total for each type."""
    return mapped.rollup("comparison_type", "category").agg(F.count("*").alias("n")).filter(F.col("comparison_type").isNotNull()).select("comparison_type", F.coalesce("category", F.lit("(all)")).alias("category"), "n")


def category_digest(rows: DataFrame, n: int = 5) -> DataFrame:
    """One line for each category: its first names, and how many more there are."""
    first = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("category").orderBy("ord"))).filter(F.col("row_no") <= n)
    names = first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "name"))), lambda s: s["name"]), ", ").alias("names"))
    counts = rows.groupBy("category").agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > n, F.format_string(" 외 %d개", F.col("total") - n)).otherwise("")
    return names.join(counts, "category").select("category", F.concat("names", more).alias("line"))


def executive_summary(counts: DataFrame, advice: DataFrame, n: int = 3) -> DataFrame:
    """One row: the comparison counts and the first n insights."""
    first = advice.orderBy("product", "rule").limit(n).agg(F.array_join(F.array_sort(F.collect_list("advice")), " | ").alias("insights"))
    return counts.crossJoin(F.broadcast(first))


def catalogue_summary(rows: DataFrame) -> DataFrame:
    """By category: members, those of high granularity (confidence of 0.8 and more), mean confidence."""
    return rows.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def quality_bucket(n_pages: Column) -> Column:
    return F.when(n_pages == 0, "low").when(n_pages < 5, "medium").otherwise("high")


def assemble_corpus(pages: DataFrame, cap: int = 8000, per_page: int = 300, links: DataFrame | None = None, n_links: int = 10) -> DataFrame:
    """Labelled page blocks of each product in page order, cut to cap; with links (ord, place, text) a page's first link texts too.

    Only as many first pages as can reach the cap are gathered, so a large product does not meet in one row.
    """
    block = F.concat(F.lit("["), "title", F.lit("] "), F.substring("content", 1, per_page))
    if links is not None:
        first = links.withColumn("row_no", F.row_number().over(Window.partitionBy("ord").orderBy("place"))).filter(F.col("row_no") <= n_links)
        texts = first.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda s: s["text"]), ", ").alias("link_texts"))
        pages = pages.join(texts, "ord", "left")
        block = F.concat(block, F.coalesce(F.concat(F.lit(" links: "), "link_texts"), F.lit("")))
    sized = pages.withColumn("block", block)
    before = F.coalesce(F.sum(F.length("block") + 1).over(Window.partitionBy("product").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sized.withColumn("before", before).filter(F.col("before") < cap)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda s: s["block"]), "\n")
    return kept.groupBy("product").agg(F.substring(joined, 1, cap).alias("corpus"), F.count("*").alias("n_blocks"))


def named_products(rows: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Blank product names become product<n> by their place in the order of ord.

    Places are counted within ranges of ord; what comes before a range is a sum over the ranges, of which there are as many as
    partitions.  `keep` writes the ranges, so that both steps see the same.
    """
    place = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange("ord").sortWithinPartitions("ord")
    ranged = keep(ranged.withColumns({"__range": F.shiftright(place, 33), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = ranged.join(before, "__range").withColumn("__place", F.col("__before") + F.col("__at") + 1)
    return numbered.withColumn("product", F.coalesce(F.nullif(F.trim("product"), F.lit("")), F.concat(F.lit("product"), F.col("__place")))).drop("__range", "__at", "__before", "__place")


def with_placeholders(products: DataFrame, rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Every product with its counts of features and pages and its quality; products without pages stay, as low."""
    f = rows.groupBy("product").agg(F.count("*").alias("n_features"))
    p = pages.groupBy("product").agg(F.count("*").alias("n_pages"))
    out = products.join(f, "product", "left").join(p, "product", "left").fillna(0, ["n_features", "n_pages"])
    return out.withColumn("quality", quality_bucket(F.col("n_pages")))
