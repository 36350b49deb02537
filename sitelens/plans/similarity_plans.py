"""Similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..operators import catalog, pages as P, scoring, similarity as M
from ..sources import tables as S
from ..sources.materialise import written
from .registry import query
from .scoring_plans import ANY, FEATURES, LEX, count_sql, featured, without_sql
from .scoring_plans import NAMES as NAMED

VEC = r"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
v AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1), w AS (SELECT doc_id, term, w / norm AS w FROM raw JOIN n USING (doc_id))"""
EDGES = f"WITH {VEC} SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.w * b.w), 6) AS cosine FROM w a JOIN w b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) > 0.8"


def docs(spark, d):
    return S.read(spark, d, "documents").select("doc_id", "text", "source")


@query("sim1_tfidf", f"WITH {VEC} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(max(w), 6) AS top_weight, round(sum(w), 5) AS total FROM w GROUP BY doc_id")
def sim1(spark, d):
    return M.vector_profile(M.raw_tfidf(docs(spark, d), "doc_id", "text", keep=written), "doc_id")


@query("sim1_tfidf_capped", r"""WITH t AS (SELECT page_id, regexp_extract_all(lower(html), '[\p{L}\p{N}_]{2,}') AS ws FROM pages), g AS (SELECT page_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM t), tf AS (SELECT page_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 1000), raw AS (SELECT page_id, tf * (ln((1 + (SELECT count(*) FROM pages)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)) SELECT page_id, CAST(count(*) AS BIGINT) AS n_terms, round(max(w) / sqrt(sum(w * w)), 6) AS top_weight FROM raw GROUP BY page_id""")
def sim1_capped(spark, d):
    v = M.raw_tfidf(S.pages(spark, d), "page_id", "html", 1, 2, max_features=1000, keep=written)
    return M.vector_profile(v, "page_id").drop("total")


STOPPED = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + "], w))"


@query("sim1_tfidf_words", "WITH t AS (SELECT doc_id, " + STOPPED + " AS ws FROM documents), g AS (SELECT doc_id, unnest(ws) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 1000), raw AS (SELECT doc_id, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(max(w) / sqrt(sum(w * w)), 6) AS top_weight FROM raw GROUP BY doc_id")
def sim1_words(spark, d):
    """Single words without stop words: the form that near-duplicate pages were found in."""
    v = M.raw_tfidf(docs(spark, d), "doc_id", "text", 1, 1, stop=L.STOP_WORDS, max_features=1000, keep=written)
    return M.vector_profile(v, "doc_id").drop("total")


@query("sim1_tfidf_stopped", "WITH t AS (SELECT doc_id, " + STOPPED + " AS ws FROM documents), g AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 1000), raw AS (SELECT doc_id, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(max(w) / sqrt(sum(w * w)), 6) AS top_weight FROM raw GROUP BY doc_id")
def sim1_stopped(spark, d):
    """One and two words without stop words: the form that sections of two products are matched in."""
    v = M.raw_tfidf(docs(spark, d), "doc_id", "text", 1, 2, stop=L.STOP_WORDS, max_features=1000, keep=written)
    return M.vector_profile(v, "doc_id").drop("total")


FIRSTS = "firsts AS (SELECT text, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text)"


@query("sim2_near_duplicate_edges", f"WITH {FIRSTS} SELECT e.* FROM ({EDGES}) e JOIN documents da ON da.doc_id = e.a JOIN documents db ON db.doc_id = e.b JOIN firsts x ON x.text = da.text JOIN firsts y ON y.text = db.text WHERE x.first = e.a AND (y.first = e.b OR y.first = e.a)")
def sim2_edges(spark, d):
    """Pairs of the first documents of each text, and each first document with each of its copies: every document near another has a row."""
    classes, pairs = M.near_texts(docs(spark, d), "doc_id", "text", 0.8, written)
    return M.with_members(classes, pairs, "doc_id").withColumn("cosine", F.round("cosine", 6))


@query("sim2_near_duplicate_links", f"WITH {FIRSTS}, e AS ({EDGES}) SELECT doc_id, first, CAST((SELECT count(*) FROM e WHERE e.a = doc_id OR e.b = doc_id) AS BIGINT) AS n_links FROM documents JOIN firsts USING (text) WHERE len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) > 0")
def sim2_links(spark, d):
    """A row for each document: the first one with its text, and how many others are near it."""
    classes, pairs = M.near_texts(docs(spark, d), "doc_id", "text", 0.8, written)
    return M.link_counts(written(classes), written(pairs), "doc_id")


@query("sim2_near_duplicates_removed")
def sim2(spark, d):
    """Copies follow their first document, which is near all that they are near: only first documents are decided in rounds."""
    classes, pairs = M.near_texts(docs(spark, d), "doc_id", "text", 0.8, written)
    classes = written(classes)
    kept = M.keep_first(classes.filter("doc_id = first").select(F.col("doc_id").alias("id")), pairs, written)
    without_terms = docs(spark, d).select(F.col("doc_id").alias("id")).distinct().join(classes.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return kept.unionByName(without_terms)


def sections(spark, d):
    """The 50 best-scored sentences of each product."""
    s = scoring.feature_sections(docs(spark, d), LEX).join(docs(spark, d).select("doc_id", "source"), "doc_id")
    from ..operators.reports import newest_per_group

    top = newest_per_group(s.select("source", "doc_id", "pos", "sentence", "score"), "source", [F.desc("score"), F.col("doc_id"), F.col("pos")], 50)
    return top.withColumn("id", F.concat_ws("#", "source", F.lpad(F.col("row_no").cast("string"), 3, "0")))


def section_edges(spark, d, least):
    s = written(sections(spark, d))
    v = written(M.tfidf(s, "id", "sentence", 1, 2, stop=L.STOP_WORDS, max_features=1000))
    side = lambda p: v.filter(F.col("id").startswith(p + "#"))
    return s, M.cross_cosine(side("src1"), side("src2"), "id", least)


@query("sim3_section_matches")
def sim3(spark, d):
    return M.greedy_pairs(section_edges(spark, d, 0.3)[1], written).orderBy(F.desc("cosine"), "a", "b").limit(20)


def page_matches(spark, d):
    p = S.pages(spark, d).withColumn("content", P.plain_text(F.col("html"), ["script", "style"])).select("page_id", "product", "content")
    from ..operators.reports import newest_per_group

    top = written(newest_per_group(p, "product", [F.desc(F.length("content")), F.col("page_id")], 50))
    v = written(M.tfidf(top, "page_id", "content", 1, 3, max_features=2000, max_df=0.95).join(top.select("page_id", "product"), "page_id"))
    e = M.cross_cosine(v.filter("product = 'com'"), v.filter("product = 'net'"), "page_id", 0.01)
    text = top.select("page_id", F.substring("content", 1, 300).alias("text"))
    pairs = M.greedy_pairs(e, written).orderBy(F.desc("cosine"), "a", "b").limit(15)
    return pairs.join(text.select(F.col("page_id").alias("a"), F.col("text").alias("t1")), "a").join(text.select(F.col("page_id").alias("b"), F.col("text").alias("t2")), "b")


@query("sim4_page_matches")
def sim4(spark, d):
    out = M.pair_verdicts(page_matches(spark, d), "t1", "t2")
    return out.withColumn("cosine", F.round("cosine", 3))


@query("sim5_greedy_assignment")
def sim5(spark, d):
    """Customers to suppliers they bought from, by the amount: each supplier and customer once."""
    lines = S.read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("b"), "l_extendedprice")
    orders = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("a"))
    bought = lines.join(orders, "l_orderkey").groupBy("a", "b").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("cosine"))
    return M.greedy_pairs(bought, written)


SIDE = r"SELECT p_partkey AS id, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]{2,}'))) AS ts FROM part WHERE p_brand"
TITLE_SCORE = "round(len(list_intersect(x.ts, y.ts)) / (len(x.ts) + len(y.ts) - len(list_intersect(x.ts, y.ts)))::DOUBLE, 6)"


@query("sim6_title_matches", f"WITH x AS ({SIDE} < 'Brand#3'), y AS (SELECT ts, min(id) AS id FROM ({SIDE} >= 'Brand#3') GROUP BY ts), s AS (SELECT x.ts, y.id AS b, {TITLE_SCORE} AS similarity FROM (SELECT DISTINCT ts FROM x) x CROSS JOIN y), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY similarity DESC, b) AS r FROM s WHERE similarity > 0.3) WHERE r = 1) SELECT x.id AS a, m.b, coalesce(m.similarity, 0.0) AS similarity, CASE WHEN m.similarity > 0.5 THEN 'O' WHEN m.similarity > 0.3 THEN '△' ELSE 'X' END AS status FROM x LEFT JOIN m ON m.ts = x.ts")
def sim6(spark, d):
    f = S.features(spark, d).select(F.col("ord").alias("id"), F.col("name").alias("title"), "product")
    return M.title_matches(f.filter("product < 'Brand#3'"), f.filter("product >= 'Brand#3'"), written)


SYN = L.SYNONYMS | L.SAMPLE_SYNONYMS
NAMES = "(SELECT DISTINCT lower(p_name) AS n FROM part)"
GROUP = lambda a, b: "CASE WHEN " + " OR ".join(f"({ANY(a, [k, *v])} AND {ANY(b, [k, *v])})" for k, v in SYN.items()) + " THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"
JAC = "len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))::DOUBLE"
SIMILAR = f"CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 ELSE round(least(0.7::DOUBLE * ({JAC}) + {GROUP('a', 'b')}, 1.0), 6) END::DOUBLE"


def names(spark, d):
    return S.features(spark, d).select(catalog.normalised_name(F.col("name")).alias("norm")).distinct()


@query("sim7_name_similarity", f"SELECT x.n AS a, y.n AS b, similarity FROM (SELECT a AS n, b, {SIMILAR} AS similarity FROM (SELECT x.n AS a, y.n AS b FROM {NAMES} x JOIN {NAMES} y ON x.n < y.n)) x JOIN {NAMES} y ON y.n = x.b WHERE similarity > 0")
def sim7(spark, d):
    pairs = M.candidate_pairs(written(names(spark, d)), SYN)
    return pairs.withColumn("similarity", M.name_similarity(F.col("a"), F.col("b"), SYN, 0)).filter("similarity > 0")


@query("sim7_name_similarity_full")
def sim7_full(spark, d):
    """With the sequence ratio: its weight is 0.3, so above 0.3 no pair but the candidates is possible."""
    pairs = M.candidate_pairs(written(names(spark, d)), SYN)
    return pairs.withColumn("similarity", M.name_similarity(F.col("a"), F.col("b"), SYN)).filter("similarity > 0.3")


@query("sim8_synonym_bonus", f"SELECT a, b, bonus FROM (SELECT a, b, {GROUP('a', 'b')} AS bonus FROM (SELECT x.n AS a, y.n AS b FROM {NAMES} x JOIN {NAMES} y ON x.n < y.n)) WHERE bonus > 0")
def sim8(spark, d):
    return M.synonym_pairs(names(spark, d), SYN).withColumn("bonus", F.lit(0.4))


def catalogue(spark, d):
    f = S.features(spark, d)
    return f.select("product", catalog.normalised_name(F.col("name")).alias("norm"), "ord", "description", F.concat(F.lit("https://example.com/"), "ord").alias("url"), "confidence")


MATRIX = f"""WITH c AS (SELECT * FROM (SELECT product, lower(name) AS a, description, 'https://example.com/' || ord AS url, confidence, ord, row_number() OVER (PARTITION BY product, lower(name) ORDER BY ord) AS r FROM features_v) WHERE r = 1),
t AS (SELECT a, b, {SIMILAR} AS similarity FROM (SELECT DISTINCT a FROM c) CROSS JOIN (SELECT n AS b FROM {NAMES})),
s AS (SELECT * FROM (SELECT product, b AS feature, similarity, description, url, confidence, row_number() OVER (PARTITION BY product, b ORDER BY similarity DESC, ord) AS r FROM c JOIN t USING (a) WHERE similarity > 0.05) WHERE r = 1)
SELECT p.product, n.n AS feature, CASE WHEN s.similarity IS NULL THEN 'X' ELSE 'O' END AS status, coalesce(s.similarity, 0.0) AS similarity, coalesce(s.description, '') AS description, coalesce(s.url, '') AS source_url, coalesce(s.confidence, 0.0) AS confidence
FROM (SELECT DISTINCT product FROM c) p CROSS JOIN {NAMES} n LEFT JOIN s ON s.product = p.product AND s.feature = n.n"""


@query("sim9_support_matrix", MATRIX)
def sim9(spark, d):
    rows = written(catalogue(spark, d))
    return M.support_matrix(rows, rows.select("norm").distinct(), SYN, written, ratio_weight=0)


@query("sim9_support_matrix_full")
def sim9_full(spark, d):
    """With the sequence ratio, which no SQL has: tests hold it against loops over the same names."""
    rows = written(catalogue(spark, d))
    return M.support_matrix(rows, rows.select("norm").distinct(), SYN, written)


@query("sim10_shared_names", r"SELECT p_partkey AS id, coalesce(list_sort(list_transform(list_intersect(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]{2,}'), regexp_extract_all(lower(p_type), '[\p{L}\p{N}_]{2,}')), lambda t: struct_pack(n := -length(t), t := t)))[1].t, substr(p_name, 1, 20)) AS shared FROM part")
def sim10(spark, d):
    return S.features(spark, d).select(F.col("ord").alias("id"), M.longest_shared(F.col("name"), F.col("category")).alias("shared"))


TERMS = [t for ts in LEX.values() for t in ts]
HELD = "list_filter([{}], lambda t: contains(lower({}), t))"
X_TERMS, Y_TERMS = (HELD.format(", ".join(f"'{t}'" for t in sorted(TERMS)), c) for c in ("p_name", "p_type"))


@query("sim10_shared_keywords", f"SELECT id, coalesce(list_sort(list_transform(list_intersect(x, y), lambda t: struct_pack(n := -length(t), t := t)))[1].t, x[1], y[1], '기능') AS shared FROM (SELECT p_partkey AS id, {X_TERMS} AS x, {Y_TERMS} AS y FROM part)")
def sim10_keywords(spark, d):
    return S.features(spark, d).select(F.col("ord").alias("id"), M.shared_keyword(F.col("name"), F.col("category"), TERMS).alias("shared"))


SIDES = "SELECT *, CASE WHEN p{i} > n{i} THEN 'O' WHEN n{i} > p{i} THEN 'X' ELSE '△' END AS s{i} FROM ({inner})"
SCORED = "SELECT a.doc_id AS a, b.doc_id AS b, a.text AS t1, b.text AS t2, {p1} AS p1, {n1} AS n1, {p2} AS p2, {n2} AS n2 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1".format(
    **{f"p{i}": count_sql(without_sql(f"lower({c}.text)", L.NEGATIVE), L.POSITIVE) for i, c in ((1, "a"), (2, "b"))}, **{f"n{i}": count_sql(f"lower({c}.text)", L.NEGATIVE) for i, c in ((1, "a"), (2, "b"))}
)
SURE = "CASE s{i} WHEN 'O' THEN least(0.8 + 0.1 * p{i}, 0.95) WHEN 'X' THEN least(0.8 + 0.1 * n{i}, 0.95) ELSE 0.6 END::DOUBLE"
CUT = "CASE WHEN length(t{i}) > 100 THEN substr(t{i}, 1, 100) || '...' ELSE t{i} END"


@query("sim11_text_pairs", f"SELECT a, b, s1 AS status_1, s2 AS status_2, {SURE.format(i=1)} AS confidence_1, {SURE.format(i=2)} AS confidence_2, {CUT.format(i=1)} AS text_1, {CUT.format(i=2)} AS text_2 FROM ({SIDES.format(i=2, inner=SIDES.format(i=1, inner=SCORED))})")
def sim11_texts(spark, d):
    """Every document with the next one as a matched pair."""
    t = docs(spark, d)
    pairs = t.select(F.col("doc_id").alias("a"), F.col("text").alias("t1")).join(t.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("t2")), "a")
    return M.pair_verdicts(pairs.select("a", "b", "t1", "t2"), "t1", "t2")


@query("sim11_pair_verdicts")
def sim11(spark, d):
    s, e = section_edges(spark, d, 0.3)
    text = s.select("id", "sentence")
    pairs = M.greedy_pairs(e, written).orderBy(F.desc("cosine"), "a", "b").limit(20)
    return M.pair_verdicts(pairs.join(text.select(F.col("id").alias("a"), F.col("sentence").alias("t1")), "a").join(text.select(F.col("id").alias("b"), F.col("sentence").alias("t2")), "b"), "t1", "t2")


CHUNKS = r"""SELECT doc_id, i, list_filter(w[i * 500 + 1 : i * 500 + 500], lambda x: true) AS cw, array_to_string(w[i * 500 + 1 : i * 500 + 500], ' ') AS c FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 500.0) AS BIGINT))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents))"""
CHUNK_SIMILARITY = rf"""WITH ch AS (SELECT doc_id, i, c FROM ({CHUNKS}) WHERE length(c) > 50), t AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(c), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM ch), tf AS (SELECT doc_id, i, term, count(*) AS tf FROM t GROUP BY 1, 2, 3), v AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT doc_id, i, term, tf * (ln((1 + (SELECT count(*) FROM ch)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)), nn AS (SELECT doc_id, i, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1, 2),
f AS (SELECT feature, unnest(ts) AS term, 1 / sqrt(len(ts)) AS u FROM (SELECT feature, list_distinct(regexp_extract_all(feature, '[\p{{L}}\p{{N}}_]{{2,}}')) AS ts FROM (VALUES ('of the'), ('free data'), ('and')) AS x(feature))),
s AS (SELECT doc_id, i, feature, sum(w / norm * u) AS cosine FROM raw JOIN nn USING (doc_id, i) JOIN f USING (term) GROUP BY 1, 2, 3) SELECT doc_id, feature, round(max(cosine), 6) AS similarity FROM s GROUP BY 1, 2"""


@query("lex13_chunk_similarity", CHUNK_SIMILARITY)
def lex13(spark, d):
    f = spark.createDataFrame([("of the",), ("free data",), ("and",)], "feature string")
    return M.chunk_similarity(docs(spark, d), f, "doc_id", "text", written)


@query("lex9_feature_support_similar")
def lex9_similar(spark, d):
    """The cascade with its fourth stage: the best chunk's cosine is joined to each document and feature."""
    wanted = spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    near = M.chunk_similarity(docs(spark, d), wanted, "doc_id", "text", written)
    return scoring.similar_support(featured(spark, d), near, "doc_id", NAMED).withColumn("confidence", F.round("confidence", 6))
