"""Chunk similarity and the cascade with it, against loops and without texts or terms in a shuffle."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sitelens.operators import scoring as C
from sitelens.operators import similarity as M
from sitelens.sources.materialise import written

FEATURES = ["file upload", "of the", "rare", "nowhere at all"]


def made_docs():
    rng = random.Random(8)
    words = ["file", "upload", "of", "the", "Élan", "x", *(f"w{i}" for i in range(60))]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90)) + [f"only{i}"] * rng.randint(0, 2))) for i in range(40)]
    return [*texts, (50, None), (51, ""), (52, "? " * 40), (53, "rare words stand in here once, at the end of a text of some length"), (3, "the same id with another file of the upload, longer than fifty")]


def similarities(docs, size):
    chunks = {}
    for i, t in docs:
        words = (t or "").split()
        for c in range(0, len(words), size):
            part = " ".join(words[c : c + size])
            if len(part) > 50:
                chunks.setdefault((i, c // size), Counter()).update(re.findall(r"\w{2,}", part.lower()))
    df = Counter(w for c in chunks.values() for w in c)
    out = {}
    for (i, _), c in chunks.items():
        w = {t: n * (math.log((1 + len(chunks)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for f in FEATURES:
            terms = set(re.findall(r"\w{2,}", f))
            if terms & set(w):
                out[i, f] = max(out.get((i, f), 0), sum(w.get(t, 0) / norm / math.sqrt(len(terms)) for t in terms))
    return out


@pytest.mark.parametrize("most_shared", [0, 20, 1000])
def test_chunk_similarity_equals_loops(spark, most_shared):
    df = spark.createDataFrame(made_docs(), "doc_id long, text string")
    wanted = spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    got = {(r.doc_id, r.feature): r.similarity for r in M.chunk_similarity(df, wanted, "doc_id", "text", written, 30, most_shared).collect()}
    want = similarities(made_docs(), 30)
    assert set(got) == set(want) and all(abs(got[k] - x) < 2e-6 for k, x in want.items())


def test_no_terms_of_chunks_are_written(spark):
    """Only documents of terms and the features' own terms are: nothing that grows with the terms of all chunks."""
    rng, sizes = random.Random(2), []
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(400))) for i in range(200)], "doc_id long, text string")

    def keep(table):
        out = written(table)
        sizes.append(out.count())
        return out

    assert M.chunk_similarity(df, spark.createDataFrame([("w1 w2",)], "feature string"), "doc_id", "text", keep).count() > 0
    assert sum(sizes) <= 301 + 2  # terms, and one row for what stands everywhere; before 200 * 300


def test_verdicts_are_joined_without_texts(spark):
    docs = spark.createDataFrame([(i, t or "") for i, t in made_docs() if i != 3], "doc_id long, text string").withColumn("source", F.lit("s"))
    wanted = spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    near = spark.createDataFrame([(i, f, rng / 100) for i, f, rng in ((1, "rare", 45), (2, "rare", 30), (4, "nowhere at all", 95), (53, "rare", 60))], "doc_id long, feature string, similarity double")
    asked, names = C.asked_of(docs, wanted), {"upload": ["w1"]}
    got = C.similar_support(asked, near, "doc_id", names)
    v = C.feature_support(F.col("text"), F.col("feature"), names, similar=F.coalesce("similarity", F.lit(0.0)), prepared=True)
    want = asked.join(near, ["doc_id", "feature"], "left").select("doc_id", "feature", v.alias("v")).select("doc_id", "feature", "v.status", "v.confidence")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("confidence = 0.45").count() == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.similar_support(asked, near, "doc_id", names)._jdf.queryExecution()
        kinds = plan.optimizedPlan().children().apply(0).children().apply(0).output().toString()
        assert "before#" in kinds and "text#" not in kinds and "__sentences#" not in kinds
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
