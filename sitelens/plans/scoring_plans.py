"""Lexicon and verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..operators import scoring as C
from ..sources import tables as S
from ..sources.materialise import written
from .registry import query

LEX = L.SAMPLE_CATEGORIES
ROWS = ", ".join(f"('{c}', {i}, '{t}', {j})" for i, (c, ts) in enumerate(LEX.items()) for j, t in enumerate(ts))
LEXICON = f"(VALUES {ROWS}) AS x(category, category_rank, term, term_rank)"
KEYS = ["of the", "free data", "the bot is free", "zebra crossing", "and"]
KEYWORDS = "(VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYS)) + ") AS k(keyword_id, keyword)"
WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


def q(items):
    return [i.replace("'", "''") for i in items]


def count_sql(column, terms):
    return "(" + " + ".join(f"CAST(contains({column}, '{t}') AS INTEGER)" for t in q(terms)) + ")"


def without_sql(column, terms):
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        column = f"replace({column}, '{t}', ' ')"
    return column


def first_sql(column, terms):
    return "coalesce(" + ", ".join(f"CASE WHEN contains({column}, '{t}') THEN '{t}' END" for t in q(terms)) + ")"


SCORE = lambda c: f"round(greatest(0.1::DOUBLE * {count_sql(c, [t for ts in LEX.values() for t in ts])} + 0.2::DOUBLE * {count_sql(c, L.POSITIVE)} - 0.1::DOUBLE * {count_sql(c, L.NEGATIVE)}, 0.0), 6)"
P, N = count_sql(without_sql("lower(text)", L.NEGATIVE), L.POSITIVE), count_sql("lower(text)", L.NEGATIVE)
SENT = r"string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
SUPPORT = f"""SELECT doc_id, keyword_id, keyword, CASE WHEN contains(low, keyword) THEN 'O' WHEN len(parts) > 1 AND len(found) >= 0.7 * len(parts) THEN '△' WHEN len(shared) > 0 THEN '△' ELSE 'X' END AS status,
CASE WHEN contains(low, keyword) THEN 0.9 WHEN len(parts) > 1 AND len(found) >= 0.7 * len(parts) THEN 0.7 WHEN len(shared) > 0 THEN 0.6 WHEN {first_sql('low', L.KEYWORD_NEGATIVE)} IS NOT NULL THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
CASE WHEN contains(low, keyword) THEN keyword WHEN len(parts) > 1 AND len(found) >= 0.7 * len(parts) THEN array_to_string(found, ', ') WHEN len(shared) > 0 THEN array_to_string(list_sort(shared)[1:3], ', ') ELSE coalesce({first_sql('low', L.KEYWORD_NEGATIVE)}, '') END AS matched FROM
(SELECT *, CASE WHEN len(both_) >= 0.5 * len(list_distinct(parts)) THEN both_ ELSE [] END AS shared FROM (SELECT doc_id, keyword_id, keyword, low, parts, list_filter(parts, lambda w: contains(low, w)) AS found, list_filter(list_distinct(parts), lambda w: list_contains(tokens, w)) AS both_ FROM
(SELECT doc_id, lower(text) AS low, {WORDS.format('lower(text)')} AS tokens FROM documents) CROSS JOIN (SELECT keyword_id, keyword, {WORDS.format('keyword')} AS parts FROM {KEYWORDS})))"""


def docs(spark, d):
    return S.read(spark, d, "documents").select("doc_id", "text", "source")


def lexicon(spark):
    return L.as_table(spark, LEX)


def keywords(spark):
    return spark.createDataFrame([(0, i, k) for i, k in enumerate(KEYS)], "project_id int, keyword_id int, keyword string")


def product_pages(spark, d):
    return docs(spark, d).select(F.col("source").alias("product"), F.col("doc_id").alias("ord"), F.concat(F.lit("doc"), "doc_id").alias("url"), F.col("text").alias("content"))


@query("lex1_keywords", f"SELECT doc_id, string_agg(DISTINCT term, ',' ORDER BY term) AS keywords FROM documents JOIN {LEXICON} ON contains(lower(text), term) GROUP BY doc_id")
def lex1(spark, d):
    return C.keywords_of(docs(spark, d), "doc_id", F.col("text"), lexicon(spark))


@query("lex2_first_category", f"SELECT doc_id, coalesce(arg_min(category, category_rank) FILTER (contains(lower(text), term)), '기타') AS category FROM documents CROSS JOIN {LEXICON} GROUP BY doc_id")
def lex2(spark, d):
    return C.first_category(docs(spark, d), "doc_id", F.col("text"), lexicon(spark))


@query("lex3_feature_score", f"SELECT doc_id, {SCORE('lower(text)')} AS score FROM documents")
def lex3(spark, d):
    return docs(spark, d).select("doc_id", C.feature_score(F.col("text"), LEX).alias("score"))


@query("lex4_feature_sections", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM (SELECT doc_id, pos, s, {SCORE('lower(s)')} AS score FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {SENT.format('text')} AS l FROM documents)) WHERE length(s) >= 10) WHERE score > 0.3) WHERE rank <= 50")
def lex4(spark, d):
    return C.feature_sections(docs(spark, d), LEX).select("doc_id", "pos", "score", F.col("rank").cast("long").alias("rank"))


@query("lex5_polarity", f"SELECT doc_id, CASE WHEN p > n THEN 'O' WHEN n > p THEN 'X' ELSE '△' END AS status, CASE WHEN p > n THEN least(0.8::DOUBLE + 0.1::DOUBLE * p, 0.95) WHEN n > p THEN least(0.8::DOUBLE + 0.1::DOUBLE * n, 0.95) ELSE 0.6 END::DOUBLE AS confidence FROM (SELECT doc_id, {P} AS p, {N} AS n FROM documents)")
def lex5(spark, d):
    v = C.polarity(F.col("text"))
    return docs(spark, d).select("doc_id", v.alias("v")).select("doc_id", "v.status", "v.confidence")


@query("lex6_keyword_support", SUPPORT)
def lex6(spark, d):
    pages = docs(spark, d).select(F.lit(0).alias("project_id"), F.col("doc_id").alias("page_id"), F.col("text").alias("content"))
    return C.analyse_pages(pages, keywords(spark)).withColumnRenamed("page_id", "doc_id")


@query("lex7_token_overlap", f"SELECT doc_id, keyword_id, array_to_string(list_sort(both_), ' ') AS shared FROM (SELECT doc_id, keyword_id, parts, list_filter(list_distinct(parts), lambda w: list_contains(tokens, w)) AS both_ FROM (SELECT doc_id, {WORDS.format('lower(text)')} AS tokens FROM documents) CROSS JOIN (SELECT keyword_id, {WORDS.format('keyword')} AS parts FROM {KEYWORDS})) WHERE len(both_) > 0 AND len(both_) >= 0.5 * len(list_distinct(parts))")
def lex7(spark, d):
    both = docs(spark, d).join(F.broadcast(keywords(spark)), how="cross").withColumn("shared", C.overlap(F.col("text"), F.col("keyword"))).filter(F.size("shared") > 0)
    return both.select("doc_id", "keyword_id", F.array_join(F.array_sort("shared"), " ").alias("shared"))


@query("lex8_page_keyword_analysis", f"SELECT keyword, status, CAST(count(*) AS BIGINT) AS n FROM ({SUPPORT}) GROUP BY 1, 2")
def lex8(spark, d):
    return lex6(spark, d).groupBy("keyword", "status").agg(F.count("*").alias("n"))


FEATURES = ["file upload", "of the", "chat", "and then", "steel door"]
FEATURE_ROWS = "(VALUES " + ", ".join(f"('{f}')" for f in FEATURES) + ") AS f(feature)"
NAMES = L.FEATURE_SYNONYMS | L.SAMPLE_FEATURE_SYNONYMS
SYNONYM = "coalesce(" + ", ".join(f"CASE WHEN (contains('{k.lower()}', feature) OR contains(feature, '{k.lower()}')) AND contains(low, '{v.lower()}') THEN '{v}' END" for k, vs in NAMES.items() for v in vs) + ")"
HIT_P, HIT_N = count_sql(without_sql("hit", L.NEGATIVE), L.POSITIVE), count_sql("hit", L.NEGATIVE)
ANY = lambda c, ts: "(" + " OR ".join(f"contains({c}, '{t}')" for t in q(ts)) + ")"
STAGES = f"""SELECT doc_id, feature, low, syn, hit, CASE WHEN hit IS NULL THEN NULL WHEN {ANY('feature', L.ADVANCED)} THEN CASE WHEN {ANY('hit', L.DENIAL)} THEN 'X' WHEN {ANY('hit', L.SUPPORT)} THEN 'O' ELSE '△' END WHEN {HIT_P} > {HIT_N} THEN 'O' WHEN {HIT_N} > {HIT_P} THEN 'X' ELSE '△' END AS ctx, {first_sql('low', L.NEGATIVE)} AS neg FROM
(SELECT *, {SYNONYM} AS syn, list_filter(sents, lambda s: len(list_filter(parts, lambda w: contains(s, w))) > 0)[1] AS hit FROM (SELECT doc_id, lower(text) AS low, {SENT.format('lower(text)')} AS sents FROM documents) CROSS JOIN (SELECT feature, {WORDS.format('feature')} AS parts FROM {FEATURE_ROWS}))"""


def featured(spark, d):
    return C.asked_of(docs(spark, d), spark.createDataFrame([(f,) for f in FEATURES], "feature string"))


@query("lex9_feature_support", f"SELECT doc_id, feature, CASE WHEN contains(low, feature) OR syn IS NOT NULL THEN 'O' WHEN ctx IS NOT NULL THEN ctx WHEN neg IS NOT NULL THEN 'X' WHEN {ANY('feature', L.BASIC)} THEN 'O' ELSE 'X' END AS status, CASE WHEN contains(low, feature) THEN 0.95 WHEN syn IS NOT NULL THEN 0.85 WHEN ctx IS NOT NULL THEN CASE WHEN {ANY('feature', L.ADVANCED)} THEN CASE ctx WHEN 'O' THEN 0.85 WHEN 'X' THEN 0.9 ELSE 0.6 END ELSE CASE ctx WHEN 'O' THEN 0.75 WHEN 'X' THEN 0.8 ELSE 0.6 END END WHEN neg IS NOT NULL THEN 0.9 WHEN {ANY('feature', L.BASIC)} THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM ({STAGES})")
def lex9(spark, d):
    return featured(spark, d).select("doc_id", "feature", C.feature_support(F.col("text"), F.col("feature"), NAMES, prepared=True).alias("v")).select("doc_id", "feature", "v.status", "v.confidence")


@query("lex10_direct_substring", "SELECT doc_id, feature FROM documents CROSS JOIN " + FEATURE_ROWS + " WHERE contains(lower(text), feature)")
def lex10(spark, d):
    return featured(spark, d).filter(F.col("__low").contains(F.col("feature"))).select("doc_id", "feature")


@query("lex11_synonyms", f"SELECT doc_id, feature, syn AS matched FROM ({STAGES}) WHERE syn IS NOT NULL")
def lex11(spark, d):
    return featured(spark, d).select("doc_id", "feature", C.by_synonym(F.col("__low"), F.col("feature"), NAMES)["matched"].alias("matched")).filter("matched IS NOT NULL")


@query("lex12_context", f"SELECT doc_id, feature, ctx AS status, CASE WHEN length(hit) > 100 THEN substr(hit, 1, 100) || '...' ELSE hit END AS evidence FROM ({STAGES}) WHERE ctx IS NOT NULL")
def lex12(spark, d):
    return featured(spark, d).select("doc_id", "feature", C.in_context(F.col("text"), F.col("feature"), sentences=F.col("__sentences"), parts=F.col("__parts")).alias("v")).filter("v IS NOT NULL").select("doc_id", "feature", "v.status", F.col("v.matched").alias("evidence"))


@query("lex14_word_chunks", r"SELECT doc_id, CAST(i AS BIGINT) AS chunk_no, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, i, array_to_string(w[i * 500 + 1 : i * 500 + 500], ' ') AS c FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 500.0) AS BIGINT))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents))) WHERE length(c) > 50 AND i * 500 >= 0")
def lex14(spark, d):
    # short chunks are the last ones, so places of the others are chunk numbers
    rows = docs(spark, d).select("doc_id", F.posexplode(C.word_chunks(F.col("text"), longer_than=50)).alias("chunk_no", "c"))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


@query("lex15_negative_and_basic", f"SELECT doc_id, {first_sql('lower(text)', L.NEGATIVE)} AS negative, {ANY('lower(text)', L.BASIC)} AS basic FROM documents")
def lex15(spark, d):
    from ..functions import text as T

    return docs(spark, d).select("doc_id", C.first_phrase(F.lower("text"), L.NEGATIVE).alias("negative"), T.has_any(F.lower("text"), L.BASIC).alias("basic"))


#: The verdict of each text, and the stage that decided it, of the rows in STAGES.
STAGED = f"""SELECT source, doc_id, feature, CASE WHEN contains(low, feature) THEN 0 WHEN syn IS NOT NULL THEN 1 WHEN ctx IS NOT NULL THEN 2 WHEN neg IS NOT NULL THEN 3 WHEN {ANY('feature', L.BASIC)} THEN 4 ELSE 5 END AS stage,
CASE WHEN contains(low, feature) OR syn IS NOT NULL THEN 'O' WHEN ctx IS NOT NULL THEN ctx WHEN neg IS NOT NULL THEN 'X' WHEN {ANY('feature', L.BASIC)} THEN 'O' ELSE 'X' END AS status,
CASE WHEN contains(low, feature) THEN 0.95 WHEN syn IS NOT NULL THEN 0.85 WHEN ctx IS NOT NULL THEN CASE WHEN {ANY('feature', L.ADVANCED)} THEN CASE ctx WHEN 'O' THEN 0.85 WHEN 'X' THEN 0.9 ELSE 0.6 END ELSE CASE ctx WHEN 'O' THEN 0.75 WHEN 'X' THEN 0.8 ELSE 0.6 END END
WHEN neg IS NOT NULL THEN 0.9 WHEN {ANY('feature', L.BASIC)} THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM ({STAGES}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE low IS NOT NULL"""


@query("lex16_two_product_support", f"""WITH v AS (SELECT source, feature, arg_min(status, (stage, doc_id)) AS status, arg_min(confidence, (stage, doc_id)) AS confidence FROM ({STAGED}) GROUP BY 1, 2)
SELECT feature, max(status) FILTER (source = 'src1') AS status_1, max(confidence) FILTER (source = 'src1') AS confidence_1, max(status) FILTER (source = 'src2') AS status_2, max(confidence) FILTER (source = 'src2') AS confidence_2 FROM v WHERE source IN ('src1', 'src2') GROUP BY feature""")
def lex16(spark, d):
    """Requested features, as a user writes them, in the corpora of two products."""
    wanted = spark.createDataFrame([(f,) for f in C.requested_features(", ".join([*FEATURES, " "]))], "feature string")
    texts = docs(spark, d).select(F.col("source").alias("product"), F.col("doc_id").alias("ord"), "text")
    return C.two_product_support(texts, wanted, "src1", "src2", NAMES).drop("matched_1", "matched_2")


CATFEAT = f"SELECT product, category, terms, category || ': ' || terms AS description, 0.7::DOUBLE AS confidence, CAST(n_pages AS BIGINT) AS n_pages, sources FROM (SELECT source AS product, category, string_agg(DISTINCT term, ', ' ORDER BY term) AS terms, count(DISTINCT doc_id) AS n_pages FROM documents JOIN {LEXICON} ON contains(lower(text), term) GROUP BY 1, 2) JOIN (SELECT product, category, string_agg('doc' || doc_id, ' ' ORDER BY doc_id) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY product, category ORDER BY doc_id) AS r FROM (SELECT DISTINCT source AS product, category, doc_id FROM documents JOIN {LEXICON} ON contains(lower(text), term))) WHERE r <= 3 GROUP BY 1, 2) USING (product, category)"


@query("lex17_category_features", CATFEAT)
def lex17(spark, d):
    return C.category_features(product_pages(spark, d), lexicon(spark), written)


@query("lex18_extraction_summary", f"SELECT product, CAST(count(*) AS BIGINT) AS total_features, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, 'medium' AS quality FROM ({CATFEAT}) GROUP BY product")
def lex18(spark, d):
    return C.extraction_summary(lex17(spark, d))


@query("lex19_product_profile", "SELECT source AS product, CASE WHEN bool_or(contains(lower(text), 'idiot')) THEN 'mobile' WHEN bool_or(contains(lower(text), 'data')) THEN 'desktop' ELSE 'web' END AS product_type, CASE WHEN bool_or(contains(lower(text), 'chat')) THEN 'business' WHEN bool_or(contains(lower(text), 'bot')) THEN 'developer' ELSE 'general' END AS audience FROM documents GROUP BY source")
def lex19(spark, d):
    return C.product_profile(product_pages(spark, d), ["idiot"], ["data"], ["chat"], ["bot"])


@query("lex19_profile_with_features", "SELECT product, product_type, audience, coalesce(top_features, '') AS top_features, coalesce(top_categories, '') AS top_categories FROM (SELECT p_brand AS product, CASE WHEN bool_or(contains(lower(p_name), 'steel')) THEN 'mobile' WHEN bool_or(contains(lower(p_name), 'small')) THEN 'desktop' ELSE 'web' END AS product_type, CASE WHEN bool_or(contains(lower(p_name), 'zebra')) THEN 'business' WHEN bool_or(contains(lower(p_name), 'red')) THEN 'developer' ELSE 'general' END AS audience FROM part GROUP BY 1) LEFT JOIN (SELECT product, string_agg(name, ', ' ORDER BY ord) AS top_features FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ord) AS r FROM features_v) WHERE r <= 3 GROUP BY 1) USING (product) LEFT JOIN (SELECT product, string_agg(category, ', ' ORDER BY category) AS top_categories FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY category) AS r FROM (SELECT DISTINCT product, category FROM features_v)) WHERE r <= 3 GROUP BY 1) USING (product)")
def lex19_features(spark, d):
    f = S.features(spark, d)
    return C.product_profile(f.withColumn("content", F.col("name")), ["steel"], ["small"], ["zebra"], ["red"], f)


@query("lex20_keywords_in_context", f"SELECT doc_id, term, trim(substr(text, s, p + length(term) + 50 - s)) AS context, CAST(r AS BIGINT) AS row_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY category_rank, term_rank, term) AS r, greatest(p - 50, 1) AS s FROM (SELECT doc_id, text, term, category_rank, term_rank, strpos(lower(text), term) AS p FROM documents JOIN {LEXICON} ON contains(lower(text), term))) WHERE r <= 10")
def lex20(spark, d):
    return C.keywords_in_context(docs(spark, d), "doc_id", "text", lexicon(spark))
