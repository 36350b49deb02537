"""The order of tokens comes from all documents."""

import numpy as np
from pyspark.sql import functions as F
from sitelens.llm import jaccard_join as J


def test_all_documents_are_counted(spark):
    n = 3 * 16_384
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("own words of "), "id")).otherwise("the same four words").alias("text"))
    counts = J.token_counts(docs, J.shingling(4))
    assert counts.max() - 2 * n // 3 in range(10) and np.count_nonzero(counts) == 1


def test_what_is_put_last_does_not_grow_with_the_table(spark):
    docs = spark.range(330_000).select(F.when(F.col("id") % 5_500 == 0, F.lit("the same four words")).otherwise(F.concat(F.lit("own words of "), "id")).alias("text"))
    assert J.token_counts(docs, J.shingling(4)).max() in range(60, 70)


def test_small_groups_meet_as_large_ones_do(spark, monkeypatch):
    """Near copies in groups of 2 to 24 texts, and 24 texts that share a line; with every group as a large, or as a small one."""
    words = [f"{a}{b}" for a in "abcdefgh" for b in range(40)]
    rows, at = [], 0
    for g, size in enumerate([2, 3, 5, 9, 17, 24]):
        base = [words[(7 * g + 11 * i * i + i) % len(words)] + str(g) for i in range(60)]
        for j in range(size):
            own = list(base)
            own[(5 * j) % 60] = f"x{g}y{j}"
            rows.append((at, " ".join(own)))
            at += 1
    rows += [(at + j, "one line that all of these texts have in common " + " ".join(f"z{j}q{i}" for i in range(12))) for j in range(24)]
    docs, found = spark.createDataFrame(rows, "doc_id long, text string"), []
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    for few in (0, J.FEW, 1_000):
        monkeypatch.setattr(J, "FEW", few)
        found.append({r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()})
    assert found == [dict(enumerate(label))] * 3
