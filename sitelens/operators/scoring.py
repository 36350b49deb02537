"""Lexicon matching, scores and support verdicts.

Small fixed lexicons compile to generated columns that stay in code generation; lexicon tables join by broadcast, being
dimension tables whose size Spark checks.  Verdicts are ordered `when` chains, so the first rule that holds wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..sources.materialise import sized
from .terms import lexicon_hits, with_terms

OTHER = "기타"


def verdict(status: str, confidence: Column | float, matched: Column | str) -> Column:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    m = matched if isinstance(matched, Column) else F.lit(matched)
    return F.struct(F.lit(status).alias("status"), c.cast("double").alias("confidence"), m.alias("matched"))


def keywords_of(rows: DataFrame, key: str, text: Column, lexicon: DataFrame) -> DataFrame:
    """(key, keywords): the distinct lexicon terms in each text, ascending, comma-joined."""
    return lexicon_hits(rows.select(key, text.alias("t")), F.col("t"), lexicon, [key]).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("keywords"))


def first_category(rows: DataFrame, key: str, text: Column, lexicon: DataFrame) -> DataFrame:
    """(key, category): the first category, in order, of which the text has a term, else 'other'."""
    hits = lexicon_hits(rows.select(key, text.alias("t")), F.col("t"), lexicon, [key]).groupBy(key).agg(F.min_by("category", "category_rank").alias("category"))
    return rows.select(key).join(hits, key, "left").select(key, F.coalesce("category", F.lit(OTHER)).alias("category"))


def feature_score(text: Column, lexicon: dict[str, list[str]], positive: list[str] = L.POSITIVE, negative: list[str] = L.NEGATIVE) -> Column:
    """0.1 for each (category, term) hit, 0.2 for each positive phrase, -0.1 for each negative one, at least 0."""
    return lowered_score(F.lower(text), lexicon, positive, negative)


def lowered_score(low: Column, lexicon: dict[str, list[str]], positive: list[str] = L.POSITIVE, negative: list[str] = L.NEGATIVE) -> Column:
    """feature_score of a text that is in lower case already."""
    terms = F.lit(0)
    for words in lexicon.values():
        terms = terms + T.count_terms(low, [w.lower() for w in dict.fromkeys(words)])
    return F.round(F.greatest(0.1 * terms + 0.2 * T.count_terms(low, positive) - 0.1 * T.count_terms(low, negative), F.lit(0.0)), 6)


def feature_sections(docs: DataFrame, lexicon: dict[str, list[str]], least: float = 0.3, n: int = 50) -> DataFrame:
    """(doc_id, pos, sentence, score): the best-scored sentences of each document, ties in order of place.

    Sentences are lower-cased before they become rows and scores are exploded, since a filter on a plain column would have
    Spark lower each sentence for each term, and score it again for the output.
    """
    pairs = F.transform(T.sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"), F.lower(s).alias("low")))
    rows = docs.select("doc_id", F.posexplode(pairs).alias("pos", "x")).filter(F.length("x.sentence") >= 10)
    scores = F.explode(F.array(lowered_score(F.col("x.low"), lexicon))).alias("score")
    scored = rows.select("doc_id", "pos", F.col("x.sentence").alias("sentence"), scores).filter(F.col("score") > least)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def polarity(text: Column, positive: list[str] = L.POSITIVE, negative: list[str] = L.NEGATIVE, compat: bool = False) -> Column:
    """O, X or partial by counts of indicator phrases; negative phrases are blanked out before positives are counted."""
    low = F.lower(text)
    n = T.count_terms(low, negative)
    p = T.count_terms(low if compat else T.without(low, negative), positive)
    return F.when(p > n, verdict("O", F.least(0.8 + 0.1 * p, F.lit(0.95)), "")).when(n > p, verdict("X", F.least(0.8 + 0.1 * n, F.lit(0.95)), "")).otherwise(verdict("△", 0.6, ""))


def overlap(a: Column, b: Column, tokens: Column | None = None) -> Column:
    """Tokens of b that are tokens of a too, if at least half of b's are.  `tokens`: a's, where they are there already."""
    both = F.array_intersect(T.words(b), T.words(a) if tokens is None else tokens)
    return F.when(F.size(both) >= 0.5 * F.size(F.array_distinct(T.words(b))), both).otherwise(F.array().cast("array<string>"))


def first_phrase(low: Column, phrases: list[str]) -> Column:
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in phrases])


def keyword_support(keyword: Column, low: Column, negative: list[str] = L.KEYWORD_NEGATIVE, tokens: Column | None = None) -> Column:
    """Exact substring, most words of a phrase, shared tokens, a negative phrase, else unsupported.  `low`: lower-cased text."""
    k = F.lower(keyword)
    parts = T.words(k)
    known = F.struct(F.filter(parts, lambda w: low.contains(w)).alias("found"), overlap(low, k, tokens).alias("shared"))

    def judge(x: Column) -> Column:
        found, shared = x["found"], x["shared"]
        return (
            F.when((F.size(parts) > 1) & (F.size(found) >= 0.7 * F.size(parts)), verdict("△", 0.7, F.array_join(found, ", ")))
            .when(F.size(shared) > 0, verdict("△", 0.6, F.array_join(F.slice(F.array_sort(shared), 1, 3), ", ")))
            .when(first_phrase(low, negative).isNotNull(), verdict("X", 0.8, first_phrase(low, negative)))
            .otherwise(verdict("X", 0.5, ""))
        )

    # an array of one binds what was found to a variable, and only where the keyword itself is not there
    return F.when(low.contains(k), verdict("O", 0.9, keyword)).otherwise(F.get(F.transform(F.array(known), judge), F.lit(0)))


def with_tokens(pages: DataFrame) -> DataFrame:
    """pages (content) with __low and __tokens, made once for all keywords."""
    return pages.withColumn("__low", F.lower("content")).withColumn("__tokens", F.array_distinct(T.words(F.col("__low"))))


def analyse_pages(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every page with every keyword of its project: the verdict row.  Keywords are a broadcast dimension."""
    asked = with_tokens(pages).join(sized(keywords.filter(F.length(F.trim("keyword")) > 0)), "project_id")
    v = keyword_support(F.col("keyword"), F.col("__low"), tokens=F.col("__tokens"))
    return asked.withColumn("v", v).select("page_id", "keyword_id", "keyword", "v.*")


def asked_of(texts: DataFrame, features: DataFrame) -> DataFrame:
    """Every text with every feature of a small table.  Texts are lower-cased and split into sentences (__low, __sentences) once, not
    for each feature, and features into words (__parts) once, not for each sentence."""
    low = texts.withColumn("__low", F.lower("text")).withColumn("__sentences", T.sentences(F.col("__low")))
    return low.join(sized(features.withColumn("__parts", T.words(F.col("feature")))), how="cross")


def in_context(text: Column, feature: Column, compat: bool = False, sentences: Column | None = None, parts: Column | None = None) -> Column:
    """Verdict from the first sentence that has a word of the feature; null without one.  `sentences`, `parts`: if they are there already."""
    sentences = T.sentences(F.lower(text)) if sentences is None else sentences
    parts = T.words(feature) if parts is None else parts
    hit = F.try_element_at(F.filter(sentences, lambda s: F.exists(parts, lambda w: s.contains(w))), F.lit(1))
    advanced = T.has_any(F.lower(feature), L.ADVANCED)

    def judge(hit: Column) -> Column:
        support, denial = T.has_any(hit, L.SUPPORT), T.has_any(hit, L.DENIAL)
        by_phrase = F.when(support, "O").when(denial, "X") if compat else F.when(denial, "X").when(support, "O")
        shown = T.cut(hit, 100)
        phrase = F.when(by_phrase == "O", verdict("O", 0.85, shown)).when(by_phrase == "X", verdict("X", 0.9, shown)).otherwise(verdict("△", 0.6, shown))
        side = polarity(hit, compat=compat)["status"]
        plain = F.when(side == "O", verdict("O", 0.75, shown)).when(side == "X", verdict("X", 0.8, shown)).otherwise(verdict("△", 0.6, shown))
        return F.when(hit.isNotNull(), F.when(advanced, phrase).otherwise(plain))

    # an array of one binds the sentence to a variable, so it is found once
    return F.get(F.transform(F.array(hit), judge), F.lit(0))


def by_synonym(low: Column, feature: Column, synonyms: dict[str, list[str]]) -> Column:
    """The first variant in the text of a synonym entry that contains, or is contained in, the feature; null without one."""
    f = F.lower(feature)
    names = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(v.lower()).alias("low"), F.lit(v).alias("v")) for k, variants in synonyms.items() for v in variants])
    hit = F.filter(names, lambda x: (F.contains(x["k"], f) | F.contains(f, x["k"])) & F.contains(low, x["low"]))
    return F.get(F.transform(F.slice(hit, 1, 1), lambda x: verdict("O", 0.85, x["v"])), F.lit(0))


#: Stages of support that come before similarity.
BEFORE_SIMILAR = 3


def support_stages(text: Column, feature: Column, synonyms: dict[str, list[str]] = L.FEATURE_SYNONYMS, similar: Column | None = None, prepared: bool = False) -> list[Column]:
    """Verdicts of the six stages in order, null where one doesn't decide: substring, synonym, context, similarity, negative phrase,
    basic feature; then the verdict without any.  prepared: rows are of asked_of."""
    low, f = F.col("__low") if prepared else F.lower(text), F.lower(feature)
    known = {"sentences": F.col("__sentences"), "parts": F.col("__parts")} if prepared else {}
    stages = [F.when(low.contains(f), verdict("O", 0.95, feature)), by_synonym(low, feature, synonyms), in_context(text, f, **known)]
    if similar is not None:
        stages.append(F.when(similar > 0.3, verdict("△", F.least(similar, F.lit(0.7)), "")))
    stages.append(F.when(first_phrase(low, L.NEGATIVE).isNotNull(), verdict("X", 0.9, first_phrase(low, L.NEGATIVE))))
    stages.append(F.when(T.has_any(f, L.BASIC), verdict("O", 0.9, "기본 채팅 기능")))
    return [*stages, verdict("X", 0.3, "")]


def feature_support(text: Column, feature: Column, synonyms: dict[str, list[str]] = L.FEATURE_SYNONYMS, similar: Column | None = None, prepared: bool = False) -> Column:
    """The earliest stage that decides wins."""
    return F.coalesce(*support_stages(text, feature, synonyms, similar, prepared))


def similar_support(asked: DataFrame, near: DataFrame, key: str, synonyms: dict[str, list[str]] = L.FEATURE_SYNONYMS) -> DataFrame:
    """(key, feature, status, confidence) of feature_support with similarities (key, feature, similarity), for rows of asked_of.

    What the other stages say is judged where the texts are; only that is joined, so no text is shuffled.
    """
    stages = support_stages(F.col("text"), F.col("feature"), synonyms, prepared=True)
    short = lambda v: F.get(F.transform(F.array(v), lambda x: F.when(x.isNotNull(), F.struct(x["status"].alias("status"), x["confidence"].alias("confidence")))), F.lit(0))
    said = asked.select(key, "feature", short(F.coalesce(*stages[:BEFORE_SIMILAR])).alias("before"), short(F.coalesce(*stages[BEFORE_SIMILAR:])).alias("after"))
    by_similarity = F.when(F.col("similarity") > 0.3, F.struct(F.lit("△").alias("status"), F.least("similarity", F.lit(0.7)).alias("confidence")))
    return said.join(near, [key, "feature"], "left").select(key, "feature", F.coalesce("before", by_similarity, "after").alias("v")).select(key, "feature", "v.status", "v.confidence")


def word_chunks(text: Column, size: int = 500, longer_than: int = 50) -> Column:
    """Texts of consecutive words, those of more than so many characters."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
    return F.filter(chunks, lambda c: F.length(c) > longer_than)


def requested_features(text: str) -> list[str]:
    return [f.strip() for f in text.split(",") if f.strip()]


def two_product_support(texts: DataFrame, features: DataFrame, left: str, right: str, synonyms: dict[str, list[str]] = L.FEATURE_SYNONYMS) -> DataFrame:
    """Each feature's verdict in both products' corpora (product, ord, text), side by side; a product without texts has none.

    A corpus is judged text by text where the texts are: of all texts the earliest stage decides, and of those that it decides
    in, the first text.  That is the verdict of the texts in a row, and no corpus is put together.
    """
    both = asked_of(texts.filter(F.col("product").isin(left, right) & F.col("text").isNotNull()), features.filter(F.trim("feature") != "").distinct())
    stages = F.array(*[F.struct(F.lit(i).alias("stage"), v.alias("v")) for i, v in enumerate(support_stages(F.col("text"), F.col("feature"), synonyms, prepared=True))])
    judged = both.select("product", "feature", "ord", F.get(F.filter(stages, lambda s: s["v"].isNotNull()), F.lit(0)).alias("s"))
    found = judged.groupBy("feature", "product").agg(F.min_by("s.v", F.struct("s.stage", "ord")).alias("v"))
    of = lambda p, n: F.max(F.when(F.col("product") == p, F.col(f"v.{n}")))
    sides = [of(p, n).alias(f"{n}_{i}") for i, p in ((1, left), (2, right)) for n in ("status", "confidence", "matched")]
    return found.groupBy("feature").agg(*sides)


def category_features(pages: DataFrame, lexicon: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """For each product and category with a hit: found terms, description, the first three pages with any.

    keep writes the small rows of pages and categories that both sides start from, so that texts are searched once.
    """
    hits = lexicon_hits(pages.select("product", "ord", "url", "content"), F.col("content"), lexicon, ["product", "ord", "url"])
    pages_of = hits.groupBy("product", "category", "ord", "url").agg(F.collect_set("term").alias("terms"))
    pages_of = pages_of if keep is None else keep(pages_of)
    terms = pages_of.groupBy("product", "category").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))), ", ").alias("terms"), F.count_distinct("ord").alias("n_pages"))
    first = pages_of.select("product", "category", "ord", "url").withColumn("row_no", F.row_number().over(Window.partitionBy("product", "category").orderBy("ord"))).filter("row_no <= 3")
    sources = first.groupBy("product", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda s: s["url"]), " ").alias("sources"))
    return terms.join(sources, ["product", "category"]).select("product", "category", "terms", F.concat("category", F.lit(": "), "terms").alias("description"), F.lit(0.7).alias("confidence"), "n_pages", "sources")


def extraction_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("product").agg(F.count("*").alias("total_features"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")).withColumn("quality", F.when(F.col("total_features") > 0, "medium").otherwise("low"))


def product_profile(pages: DataFrame, mobile: list[str], desktop: list[str], business: list[str], developer: list[str], features: DataFrame | None = None) -> DataFrame:
    """Product type and audience from any hit on any page; with features (product, ord, name, category) its first three categories, in
    ascending order, and the names of its first three features."""
    low = F.lower("content")
    any_of = lambda terms: F.bool_or(T.has_any(low, terms))
    flags = pages.groupBy("product").agg(any_of(mobile).alias("m"), any_of(desktop).alias("d"), any_of(business).alias("b"), any_of(developer).alias("v"))
    profile = flags.select("product", F.when(F.col("m"), "mobile").when(F.col("d"), "desktop").otherwise("web").alias("product_type"), F.when(F.col("b"), "business").when(F.col("v"), "developer").otherwise("general").alias("audience"))
    if features is None:
        return profile
    first = features.withColumn("row_no", F.row_number().over(Window.partitionBy("product").orderBy("ord"))).filter("row_no <= 3")
    names = first.groupBy("product").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "name"))), lambda s: s["name"]), ", ").alias("top_features"))
    kinds = features.select("product", "category").distinct().withColumn("row_no", F.row_number().over(Window.partitionBy("product").orderBy("category"))).filter("row_no <= 3")
    kinds = kinds.groupBy("product").agg(F.array_join(F.array_sort(F.collect_list("category")), ", ").alias("top_categories"))
    return profile.join(names, "product", "left").join(kinds, "product", "left").fillna("", ["top_features", "top_categories"])


def keywords_in_context(rows: DataFrame, key: str, text: str, lexicon: DataFrame, around: int = 50, n: int = 10) -> DataFrame:
    """First occurrence of each term with its surroundings; the first n terms in lexicon order.

    Surroundings are cut out of each text where the terms are found, so that no text goes further.
    """
    def context(hit: Column) -> Column:
        start = F.greatest(hit["at"] - around, F.lit(1)).cast("int")
        shown = F.trim(F.substr(F.col(text), start, (hit["at"] + F.length(hit["term"]) + around - start).cast("int")))
        return F.struct(hit["term"].alias("low"), shown.alias("context"))

    found = with_terms(rows.select(key, text), F.col(text), lexicon).select(key, F.explode_outer(F.transform("hits", context)).alias("hit")).filter(F.col("hit").isNotNull()).select(key, "hit.*")
    terms = lexicon.groupBy("term").agg(F.min(F.struct("category_rank", "term_rank")).alias("place")).withColumn("low_term", F.lower("term"))
    hits = found.join(sized(terms), F.col("low") == F.col("low_term"))
    ranked = hits.withColumn("row_no", F.row_number().over(Window.partitionBy(key).orderBy("place", "term"))).filter(F.col("row_no") <= n)
    return ranked.select(key, "term", "context", F.col("row_no").cast("long").alias("row_no"))
