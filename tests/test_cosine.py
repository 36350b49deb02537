"""Cosine joins, link counts and the keep-first rule against loops over all pairs."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sitelens.operators import similarity as M
from sitelens.sources.materialise import sized, written


def weights(texts):
    """Unit vectors by the same formula, in plain dictionaries."""
    tf = {i: Counter(re.findall(r"\w{2,}", (t or "").lower())) for i, t in texts}
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for i, c in tf.items():
        raw = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        if raw:
            out[i] = {w: x / norm for w, x in raw.items()}
    return out


def near(texts, threshold):
    v = weights(texts)
    dot = lambda a, b: sum(x * v[b].get(w, 0.0) for w, x in v[a].items())
    return {(a, b): dot(a, b) for a in v for b in v if a < b and dot(a, b) > threshold}


def made_texts(rng, n):
    words = [f"w{i:03d}" for i in range(200)]
    texts = []
    for i in range(n):
        w = rng.choices(words[: rng.choice([20, 200])], k=rng.randint(1, 25))
        if texts and rng.random() < 0.6:
            w = (rng.choice(texts)[1] or "aa").split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        texts.append((i, " ".join([*w, "the", "the", "common"])))
    return [*texts, (900, None), (901, ""), (902, "? !")]


@pytest.mark.parametrize(("threshold", "most"), [(0.8, 2000), (0.8, 7), (0.5, 3), (0.95, 50)])
def test_pairs_equal_loops(spark, threshold, most):
    texts = made_texts(random.Random(int(threshold * 100) + most), 130)
    first = {}
    for i, t in texts:
        first.setdefault(t, i)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    vectors = written(M.tfidf(df, "doc_id", "text", keep=written).join(spark.createDataFrame([(i,) for i in first.values()], "doc_id long"), "doc_id"))
    got = {(r.a, r.b): r.cosine for r in M.cosine_pairs(vectors, "doc_id", threshold, written, most).collect()}
    want = {k: c for k, c in near(texts, threshold).items() if set(k) <= set(first.values())}
    assert set(got) == set(want) and all(abs(got[k] - c) < 1e-9 for k, c in want.items())


def test_bounds_prune_candidates(spark):
    """Fewer pairs are verified than share a prefix term, and none above the threshold is lost (see above)."""
    texts = made_texts(random.Random(5), 200)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    packed = written(M.packed_vectors(M.tfidf(df, "doc_id", "text"), "doc_id"))
    met = M.pairs_in_groups(M.prefixes(packed, "doc_id", 0.8), "h", "doc_id", ["w", "rest"]).select("a", "b").distinct().count()
    left = M.cosine_candidates(packed, "doc_id", 0.8, written).count()
    assert len(near(texts, 0.8)) <= left < 0.8 * met


def test_links_and_kept_documents(spark):
    texts = made_texts(random.Random(9), 90) + [(2000 + i, "many copies of one text stand here") for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    classes, pairs = M.near_texts(df, "doc_id", "text", 0.8, written)
    links = {r.doc_id: (r.first, r.n_links) for r in M.link_counts(classes, pairs, "doc_id").collect()}
    all_pairs = near(texts, 0.8)
    count = Counter(i for k in all_pairs for i in k)
    first = {}
    for i, t in texts:
        first.setdefault(t, i)
    assert links == {i: (first[t], count[i]) for i, t in texts if i in weights(texts)}
    assert pairs.count() == len([k for k in all_pairs if set(k) <= set(first.values())])  # copies add none
    kept = []
    for i in sorted(weights(texts)):
        if not any((k, i) in all_pairs for k in kept):
            kept.append(i)
    nodes = classes.filter("doc_id = first").select(F.col("doc_id").alias("id"))
    assert sorted(r.id for r in M.keep_first(nodes, pairs.select("a", "b"), written).collect()) == kept


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_pairs_of_large_groups(spark, most):
    rng = random.Random(most)
    rows = sorted({(rng.choice("ggggggh"), f"n{rng.randint(0, 40)}") for _ in range(120)})
    got = [tuple(r) for r in M.pairs_in_groups(spark.createDataFrame(rows, "g string, n string"), "g", "n", [], most).select("a", "b").collect()]
    assert Counter(got) == Counter((a, b) for g, a in rows for h, b in rows if g == h and a < b)


@pytest.mark.parametrize("most_shared", [0, 1000])
def test_copies_and_repeated_ids_have_rows(spark, most_shared):
    """Every link follows from the rows: pairs of firsts, and each first with its copies; an id with two texts is one vector."""
    texts = made_texts(random.Random(17), 90) + [(2000 + i, "many copies of one text stand here") for i in range(9)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    classes, pairs = M.near_texts(df, "doc_id", "text", 0.8, written, most_shared)
    got = {(r.a, r.b): r.cosine for r in M.with_members(classes, pairs, "doc_id").collect()}
    first = {}
    for i, t in texts:
        first.setdefault(t, i)
    text = dict(texts)
    want = {k: c for k, c in near(texts, 0.8).items() if first[text[k[0]]] == k[0] and first[text[k[1]]] in k}
    assert set(got) == set(want) and all(abs(got[k] - c) < 1e-9 for k, c in want.items())
    assert sum(a == 2000 for a, b in got) >= 8
    twice = spark.createDataFrame([(1, "aa bb cc"), (1, "dd ee"), (2, "aa bb cc dd ee"), (3, "zz")], "doc_id long, text string")
    assert [(r.a, r.b, round(r.cosine, 9)) for r in M.near_texts(twice, "doc_id", "text", 0.8, written, most_shared)[1].collect()] == [(1, 2, 1.0)]


def test_blocks_shuffle_no_pairs(spark):
    """Pairs and vectors meet where blocks are read: nothing that grows with the pairs is on a disk."""
    df = spark.createDataFrame(made_texts(random.Random(3), 60), "doc_id long, text string")
    plan = M.near_texts(df, "doc_id", "text", 0.8, written)[1]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_commonest_terms_are_found_before_counts_by_document(spark):
    """Counts by document are shuffled for the commonest terms only: what is written holds no other term, and weights are those of all terms' ranks."""
    texts = made_texts(random.Random(21), 80)
    df, kept = spark.createDataFrame(texts, "doc_id long, text string"), []

    def keep(table):
        kept.append(written(table))
        return kept[-1]

    got = {(r.doc_id, r.term): (r.w, r.df) for r in M.raw_tfidf(df, "doc_id", "text", max_features=10, keep=keep).collect()}
    tf = {i: Counter(re.findall(r"\w{2,}", (t or "").lower())) for i, t in texts}
    total, count = sum(tf.values(), Counter()), Counter(w for c in tf.values() for w in c)
    best = sorted(total, key=lambda w: (-total[w], w))[:10]
    want = {(i, w): (n * (math.log((1 + len(texts)) / (1 + count[w])) + 1), count[w]) for i, c in tf.items() for w, n in c.items() if w in best}
    assert {k: (round(w, 9), d) for k, (w, d) in got.items()} == {k: (round(w, 9), d) for k, (w, d) in want.items()}
    assert [t.select("term").distinct().count() for t in kept] == [10, 10, 10]


def test_long_texts_of_a_block_are_bounded_in_memory(spark):
    """Blocks end by their terms too, and a pair of blocks of long texts, whose common terms would be tens of millions of postings, is done in little memory."""
    rng = random.Random(31)
    long = [(i, sorted(rng.sample(range(5000), 2000))) for i in range(300)]
    rows = spark.createDataFrame([(i, h, [1 / math.sqrt(2000)] * len(h)) for i, h in [*long, (900, [])]], "id long, h array<long>, w array<double>").coalesce(1)
    blocks = M.vector_blocks(rows, "id", 4096, terms=100_000).collect()
    assert [len(b["keys"]) for b in blocks] == [50] * 6 and sorted(k for b in blocks for k in b["keys"]) == list(range(300))
    h = np.concatenate([h for _, h in long])
    vocabulary, ids = np.unique(h, return_inverse=True)
    block = M.VectorBlock(np.arange(1, 301) * 2000, vocabulary, ids, np.full(len(h), 1 / math.sqrt(2000)), np.arange(100))
    tracemalloc.start()
    got = {(int(i), int(j)): c for a, b, cosines in block.near(block, 0.42025) for i, j, c in zip(a, b, cosines, strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sets = [set(h) for _, h in long]
    want = {(i, j): len(sets[i] & sets[j]) / 2000 for i in range(300) for j in range(i + 1, 300) if len(sets[i] & sets[j]) > 840}
    assert set(got) == set(want) and all(abs(got[k] - c) < 1e-9 for k, c in want.items()) and 0 < len(want) < 5000
    assert peak < 100e6


def test_small_files_make_few_tasks(spark):
    """The number of tasks that blocks meet in follows from the blocks, not from the files."""
    vectors = written(M.tfidf(spark.createDataFrame(made_texts(random.Random(4), 60), "doc_id long, text string"), "doc_id", "text", keep=written))
    pairs = M.cosine_pairs(vectors.repartition(8, "doc_id"), "doc_id", 0.8, lambda t: written(t.repartition(8)))
    assert pairs.rdd.getNumPartitions() <= 16


def test_links_join_copies_only(spark):
    """Pairs are counted before they are shuffled: only those with a text that has copies meet its size."""
    classes = spark.createDataFrame([(1, 1, 2), (5, 1, 2), (2, 2, 1), (3, 3, 3), (6, 3, 3), (7, 3, 3), (4, 4, 1)], "doc_id long, first long, size long")
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (2, 4, 0.9)], "a long, b long, cosine double")
    got = M.link_counts(classes, pairs, "doc_id")
    assert {r.doc_id: r.n_links for r in got.collect()} == {1: 5, 5: 5, 2: 3, 3: 4, 6: 4, 7: 4, 4: 1}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan and re.search(r"size#\d+L > 1", plan)


def test_edges_shrink_with_the_rounds(spark):
    """Each round's edges are those of nodes that are still open; without later copies of decided ones."""
    kept, nodes = [], spark.range(12).select("id")

    def keep(table):
        kept.append(written(table))
        if table.columns == ["a", "b"]:
            sizes.append(kept[-1].count())
        return kept[-1]

    sizes = []
    chain = spark.createDataFrame([(i, i + 1) for i in range(11)], "a long, b long")
    assert sorted(r.id for r in M.keep_first(nodes, chain, keep).collect()) == list(range(0, 12, 2))
    assert len(sizes) > 1 and sizes[0] == 11 and all(x > y for x, y in zip(sizes, sizes[1:]))


def test_terms_of_texts_stay_where_they_are(spark, monkeypatch):
    """More first documents than are sent don't make the terms of all texts be shuffled: the fewer copies are taken out."""
    monkeypatch.setattr(sized, "__defaults__", (20,))
    plans, texts = [], made_texts(random.Random(12), 60)

    def keep(table):
        if "vocabulary" in table.columns:
            plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        return written(table)

    df = spark.createDataFrame([*texts, (950, texts[0][1]), (951, texts[1][1])], "doc_id long, text string")
    classes, pairs = M.near_texts(df.filter("doc_id < 20 OR doc_id >= 900"), "doc_id", "text", 0.8, keep)
    kept = [t for t in texts if t[0] < 20 or t[0] >= 900] + [(950, texts[0][1]), (951, texts[1][1])]
    first = {}
    for i, t in kept:
        first.setdefault(t, i)
    assert {(r.a, r.b) for r in pairs.collect()} == {k for k in near(kept, 0.8) if set(k) <= set(first.values())}
    assert len(plans) == 1 and "LeftAnti" in plans[0] and "broadcast" in plans[0] and "LeftSemi" not in plans[0].split("Relation")[0]
