"""Dimension-sharded clustering against plain loops over whole vectors."""

import hashlib
import math
import random

import pytest
from sitelens.llm import lloyd


def brute(rows, clusters, rounds, columns, scale=256, seed=2):
    """rows (vec_id, components) to sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid)."""
    kept = [(i, [max(-lloyd.LIMIT, min(lloyd.LIMIT, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == columns and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:clusters]]

    def nearest():
        return [min((sum((x - c) ** 2 for x, c in zip(v, centre, strict=True)), k) for k, centre in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        label = [k for _, k in nearest()]
        for k in range(len(centres)):
            own = [v for (_, v), at in zip(kept, label, strict=True) if at == k]
            if own:
                centres[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    final = nearest()
    inertia = {k: sum(d for d, at in final if at == k) for _, k in final}
    out = [(i, k, d, inertia[k], sum(inertia.values()), tuple(centres[k])) for (i, _), (d, k) in zip(kept, final, strict=True)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("columns", "width", "clusters", "rounds", "chunk"), [(6, 2, 5, 4, 7), (6, 6, 3, 2, 1000), (4, 1, 9, 5, 3), (2, 1, 4, 0, 5)])
def test_clusters_equal_brute_force(spark, columns, width, clusters, rounds, chunk):
    rng = random.Random(columns * 10 + width)
    rows = [(i, [rng.choice([rng.gauss(0, 1), rng.gauss(5, 0.1), 0.5]) for _ in range(columns)]) for i in range(90)]
    rows += [(i, rows[1][1]) for i in range(100, 140)]  # a third of all rows is one vector
    rows += [(3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (200, None), (201, []), (202, [1.0] * (columns + 1))]
    rows += [(203, [None] + [1.0] * (columns - 1)), (204, [float("nan")] * columns), (205, [float("inf")] * columns), (206, [1e30] + [-1e30] * (columns - 1))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, n int").repartition(5)
    got = lloyd.cluster(df, clusters, rounds, columns, width, chunk).collect()
    assert sorted(((*r[:5], tuple(r.centroid)) for r in got), key=repr) == brute(rows, clusters, rounds, columns)


def test_fewer_vectors_than_clusters(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    got = lloyd.cluster(df, 40, 5, 2, 1)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in got.collect()) == [(1, 0, 0), (2, 0, 0)]
    assert lloyd.cluster(df.limit(0), 40, 5, 2, 1).count() == 0
