"""The automaton against a loop over all terms and texts."""

import random

from pyspark.sql import functions as F
from sitelens.operators import scoring, terms


def table(spark, words):
    return spark.createDataFrame([(f"c{i % 4}", i % 4, w, i) for i, w in enumerate(words)], "category string, category_rank int, term string, term_rank int")


def brute(texts, words):
    low = {w.lower() for w in words if w.strip()}
    return {i: {(w, (t or "").lower().index(w) + 1) for w in low if w in (t or "").lower()} for i, t in texts}


def test_terms_equal_a_loop(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abAé ") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["", " ", "지원", "미지원", "abc", "bc", "c", "ABC"]
    texts = [(i, "".join(rng.choice("abcAé 지원미") for _ in range(rng.randint(0, 80)))) for i in range(80)] + [(900, None), (901, "")]
    rows = spark.createDataFrame(texts, "id int, text string").repartition(3)
    want = brute(texts, words)
    for part, few in ((1000, 0), (7, 0), (1000, 200)):  # one automaton, several behind each other, and generated columns
        got = terms.with_terms(rows, F.col("text"), table(spark, words), part=part, few=few).collect()
        assert {r.id: {(h.term, h.at) for h in r.hits} for r in got} == want
        assert all(len(r.hits) == len({h.term for h in r.hits}) for r in got)
        joined = terms.lexicon_hits(rows, F.col("text"), table(spark, words), ["id"], part, few)
        assert sorted((r.id, r.term, r.term_rank) for r in joined.collect()) == sorted((i, w, k) for i, hits in want.items() for t, _ in hits for k, w in enumerate(words) if w.lower() == t)


def test_no_terms_and_no_texts(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, text string")
    assert [r.hits for r in terms.with_terms(rows, F.col("text"), table(spark, ["x"]).limit(0)).collect()] == [[]]
    assert terms.with_terms(rows.limit(0), F.col("text"), table(spark, ["x"])).count() == 0
    assert scoring.keywords_of(rows, "id", F.col("text"), table(spark, ["b"])).count() == 0


def test_a_hundred_thousand_terms(spark, sf_dir):
    """All word pairs of the documents, up to 100,000 of them, as a lexicon; counts equal a plain search for some."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    pairs = sorted({f"{a} {b}" for t in texts.values() for a, b in zip(t.split(), t.split()[1:], strict=False)})
    words = (pairs + [f"no such term {i}" for i in range(100_000)])[:100_000]
    got = terms.with_terms(docs, F.col("text"), table(spark, words)).select("doc_id", F.explode("hits.term").alias("term")).groupBy("term").count().collect()
    counts = {r.term: r["count"] for r in got}
    for w in random.Random(1).sample(words, 60):
        assert counts.get(w, 0) == sum(w in t for t in texts.values())


def test_context_is_that_of_the_first_place(spark):
    rows = spark.createDataFrame([(1, "x" * 70 + "Alpha beta " + "y" * 70 + " alpha"), (2, "beta"), (3, None)], "id int, text string")
    got = {(r.id, r.term): (r.context, r.row_no) for r in scoring.keywords_in_context(rows, "id", "text", table(spark, ["alpha", "beta"]), 5, 1).collect()}
    assert got == {(1, "alpha"): ("xxxxxAlpha beta", 1), (2, "beta"): ("beta", 1)}
