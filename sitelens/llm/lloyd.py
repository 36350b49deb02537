"""Dimension-sharded Lloyd clustering on whole numbers.

Vectors are laid out by column blocks: each row of the written table is one block of columns of one chunk of vectors.  In a
round, each task computes exact partial distances of its blocks against the slice of the centroids that has those columns;
the partial distances of a chunk are added over its blocks and the nearest centroid is taken; then each block adds up its
own columns by cluster, and the slice of each block is updated from its own sums.  Distances and sums are exact, so
neither the order of addition nor the number of partitions changes a result.

Of all centroids' components, one row each, Spark keeps a table; they are sent to all executors, which is bounded by
clusters x columns (20 KB for 40 x 64) whatever the number of vectors.  Chunks have at most CHUNK vectors, so a task holds a
chunk's distances to all centroids at a time, and no cluster's size matters.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out; components beyond
+-LIMIT / scale count as that, so that distances fit a long; repeated rows are rows of their own; ids may be null;
equal distances go to the smaller number; an empty cluster keeps its centroid; with fewer vectors than clusters there are
as many clusters as vectors; a total beyond a long is null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, tidy, written

COLUMNS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Columns of a block, and vectors of a chunk.
WIDTH, CHUNK = 16, 1024
#: Components are at most so large; the squared distance of 64 columns then fits a long.
LIMIT = 1 << 27


def usable(embedding: Column, columns: int) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == columns) & finite, F.lit(False))


def column_blocks(vectors: DataFrame, columns: int, width: int, chunk: int, scale: int) -> DataFrame:
    """(chunk, block, n, ids, data): vectors as whole numbers, columns [block * width, ...) of n vectors; ids with block 0 only."""

    def run(batches):
        part, counter = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype(np.int32).reshape(-1, columns)
            for a in range(0, len(whole), chunk):
                piece, number = whole[a : a + chunk], (part << 32) + next(counter)
                starts = range(0, columns, width)
                ids = [batch.column("vec_id").slice(a, chunk).to_pylist(), *([None] * (len(starts) - 1))]
                data = [np.ascontiguousarray(piece[:, s : s + width]).tobytes() for s in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(data)), pa.array(range(len(data)), pa.int32()), pa.array([len(piece)] * len(data), pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary())],
                    names=["chunk", "block", "n", "ids", "data"],
                )

    return vectors.mapInArrow(tidy(run), "chunk long, block int, n int, ids array<long>, data binary")


def first_centroids(vectors: DataFrame, clusters: int, width: int, scale: int, seed: int) -> DataFrame:
    """(cluster, block, place, value) of the vectors whose hashed ids are smallest, repeated ids by their components."""
    whole = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x * F.lit(float(scale))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.select(key.alias("key"), whole.alias("v")).orderBy("key", "v").limit(clusters)
    ranked = chosen.agg(F.array_sort(F.collect_list(F.struct("key", "v"))).alias("all")).select(F.posexplode("all").alias("cluster", "one"))
    longs = ranked.select("cluster", F.posexplode("one.v").alias("column", "value"))
    return longs.select("cluster", F.floor(F.col("column") / width).cast("int").alias("block"), F.pmod("column", F.lit(width)).alias("place"), "value")


def slices(centroids: DataFrame) -> DataFrame:
    """(block, slice): each block's columns of all centroids, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("cluster", "place", "value")))
    return centroids.groupBy("block").agg(F.transform(ordered, lambda x: x["value"]).alias("slice"))


def assign(blocks: DataFrame, centroids: DataFrame, clusters: int) -> DataFrame:
    """(chunk, labels, distances): nearest centroid of each vector of a chunk, and the squared distance to it."""

    def partial(batches):
        for batch in batches:
            out = []
            for n, data, centre in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), batch.column("slice"), strict=True):
                x = np.frombuffer(data, dtype=np.int32).reshape(n, -1).astype(np.int64)
                c = centre.values.to_numpy().reshape(clusters, -1)
                gap = np.empty((n, clusters), dtype=np.int64)
                for k in range(clusters):
                    d = x - c[k]
                    gap[:, k] = (d * d).sum(axis=1)
                out.append(gap.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("n"), pa.array(out, pa.binary())], names=["chunk", "n", "gap"])

    def add(table: pa.Table) -> pa.Table:
        gaps = (np.frombuffer(g, dtype=np.int64) for g in table.column("gap").to_pylist())
        total = functools.reduce(np.add, gaps).reshape(-1, clusters)
        label = total.argmin(axis=1)
        one = [table.column("chunk")[:1].combine_chunks(), pa.array([label.tolist()], pa.list_(pa.int32())), pa.array([total.min(axis=1).tolist()], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(one, names=["chunk", "labels", "distances"])

    sent = blocks.select("chunk", "block", "n", "data").join(F.broadcast(slices(centroids)), "block")
    gaps = sent.select("chunk", "n", "data", "slice").mapInArrow(tidy(partial), "chunk long, n int, gap binary")
    return gaps.groupBy("chunk").applyInArrow(add, "chunk long, labels array<int>, distances array<long>")


def updated(blocks: DataFrame, assigned: DataFrame, centroids: DataFrame, width: int, clusters: int) -> DataFrame:
    """The centroids with each non-empty cluster's components replaced by the floor of their mean."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        count: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, data, label in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("data").to_pylist(), batch.column("labels"), strict=True):
                x, k = np.frombuffer(data, dtype=np.int32).reshape(n, -1).astype(np.int64), label.values.to_numpy()
                if block not in total:
                    total[block], count[block] = np.zeros((clusters, x.shape[1]), dtype=np.int64), np.zeros(clusters, dtype=np.int64)
                np.add.at(total[block], k, x)
                count[block] += np.bincount(k, minlength=clusters)
        for block, sums in total.items():
            k, place = (i.ravel() for i in np.indices(sums.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.astype(np.int32)), pa.array(np.full(len(k), block, dtype=np.int32)), pa.array(place.astype(np.int32)), pa.array(sums.ravel()), pa.array(count[block][k])],
                names=["cluster", "block", "place", "total", "n"],
            )

    own = blocks.select("chunk", "block", "n", "data").join(assigned.select("chunk", "labels"), "chunk")
    sums = own.select("block", "n", "data", "labels").mapInArrow(tidy(run), "cluster int, block int, place int, total long, n long")
    sums = sums.groupBy("cluster", "block", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.expr("(total - pmod(total, n)) div n")
    joined = centroids.join(sums.filter("n > 0"), ["cluster", "block", "place"], "left")
    return joined.select("cluster", "block", "place", F.coalesce(mean, "value").alias("value"))


def cluster(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, columns: int = COLUMNS, width: int = WIDTH, chunk: int = CHUNK, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """Vectors (vec_id, embedding) to (vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>)."""
    assert columns % width == 0
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding"), columns))
    blocks = written(column_blocks(kept, columns, width, chunk, scale))
    centroids = written(first_centroids(kept, clusters, width, scale, seed), True)
    have = centroids.select("cluster").distinct().count()  # fewer than asked for if there are fewer vectors
    for _ in range(rounds):
        labels = written(assign(blocks, centroids, have), True)
        moved = written(updated(blocks, labels, centroids, width, have), True)
        discard(labels)
        discard(centroids)
        centroids = moved
    labels = written(assign(blocks, centroids, have), True)
    ids = blocks.filter("block = 0").select("chunk", "ids")
    rows = ids.join(labels, "chunk").select(F.explode(F.arrays_zip("ids", "labels", "distances")).alias("r"))
    rows = rows.select(F.col("r.ids").alias("vec_id"), F.col("r.labels").alias("cluster"), F.col("r.distances").alias("distance"))
    parts = labels.select(F.explode(F.arrays_zip("labels", "distances")).alias("r")).groupBy(F.col("r.labels").alias("cluster")).agg(F.sum(F.col("r.distances").cast("decimal(38,0)")).alias("d"))
    held = parts.agg(F.expr("try_cast(sum(d) as long)").alias("inertia"), F.collect_list(F.struct("cluster", "d")).alias("all"))  # a row for each cluster
    inertia = held.select("inertia", F.explode("all").alias("one")).select(F.col("one.cluster").alias("cluster"), F.expr("try_cast(one.d as long)").alias("cluster_inertia"), "inertia")
    centre = centroids.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "value"))), lambda x: x["value"]).alias("centroid"))
    about = inertia.join(centre, "cluster")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
