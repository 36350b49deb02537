"""Near-duplicate embeddings by NN-descent.

Vectors start with neighbours from the order of random projections, then each node's neighbours are compared with one
another (neighbours of neighbours), and every node keeps its best list, until few lists change.  Links at the
threshold give components.  A list may be saturated, with more links than it has room for.  A link in neither end's
list has two saturated ends; so saturated nodes search again among themselves, with a list for the best neighbours outside
their own component beside that for those inside, and components that link are merged, until no list of outside neighbours is
saturated (each turn merges every component that has such a list).  The links of a component are then counted: its
members are compared block against block, and counted rather than listed.
An audit compares a bounded sample of all rows with all rows by brute force, counting links and counting rows; while recall
is short, more projections are added.  Where it stays short, the blocks of each label are compared, which is exact.

Edge cases: vectors that are null, zero, of null or non-finite components, or without a label link with nothing and are
their own component; equal vectors (copies) form one node; different lengths are never compared; a repeated or null
vec_id is a row like any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, tidy, written

THRESHOLD = 0.98
EDGES = "node long, other long, cosine double, same boolean"
#: Length of a node's list, projections at the start, rows compared ahead in each, rounds, and the share of changes to stop at.
NEIGHBOURS = 8
PROJECTIONS = 8
AHEAD = 16
ROUNDS = 4
SETTLED = 0.01
BLOCK = 1024
#: Rows of a block that are multiplied at once.
SLICE = 256
#: Audit: nodes sampled among all rows and among linked ones, the recall asked for, and how often projections are added before all blocks are compared.
AUDIT = 512
AUDIT_LINKED = 128
LEAST_RECALL = 0.97
EXTRA = 4


def nodes_of(rows: DataFrame) -> DataFrame:
    """Distinct usable vectors: (node, first_id, copies, part: label and length, v: the vector as given, label, own: the node itself)."""
    e = F.col("embedding")
    usable = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    merged = rows.filter(F.coalesce(usable, F.lit(False))).groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    made = written(merged.select(F.monotonically_increasing_id().alias("node"), "first_id", "copies", F.concat_ws(":", F.col("label").cast("string"), F.size("embedding")).alias("part"), F.col("embedding").alias("v"), "label"))
    return made.withColumn("own", F.col("node"))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as unit vectors in double precision."""
    n = len(column)
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, name: str):
    """Row numbers and unit vectors of each vector length in a batch."""
    column = batch.column(name)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _unit(column.take(pa.array(rows)))


def first_graph(nodes: DataFrame, n: int, seeds: list[int], k: int, ahead: int) -> DataFrame:
    """(node, other, cosine, same): the best neighbours among the rows ahead in the order of each random projection.

    `same` tells whether both are of one component (`own`).  Of a run of one component only both ends are compared ahead.
    """
    edge = max(1, ahead // 4)
    bits = max(1, math.ceil(math.log2(max(2, n) / 64))) if n > 64 else 1

    def place(batches):
        for batch in batches:
            for rows, x in _by_length(batch, "v"):
                for seed in seeds:
                    planes = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1], bits + 1))
                    side = x @ planes
                    code = (side[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(at), batch.column("own").take(at), batch.column("part").take(at), pa.array(np.full(len(rows), seed, dtype=np.int32)), pa.array(code), pa.array(side[:, bits]), batch.column("v").take(at)],
                        names=["node", "own", "part", "seed", "code", "at", "v"],
                    )

    def compare(batches):
        held: pa.RecordBatch | None = None
        for batch in batches:
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            fresh = 0 if held is None else held.num_rows
            own = table.column("own").to_numpy()
            group = pa.array(table.column("part")).dictionary_encode().indices.to_numpy(), table.column("seed").to_numpy(), table.column("code").to_numpy()
            keep = ends_of_runs([own, *group], edge)
            if not keep.all():
                fresh, table, own, group = int(keep[:fresh].sum()), table.filter(pa.array(keep)), own[keep], tuple(g[keep] for g in group)
            node = table.column("node").to_numpy()
            out: list[tuple] = []
            for rows, x in _by_length(table, "v"):
                for lag in range(1, min(ahead, len(rows) - 1) + 1):
                    a, b = rows[:-lag], rows[lag:]
                    same = np.logical_and.reduce([g[a] == g[b] for g in group]) & (b >= fresh)
                    cosine = np.einsum("ij,ij->i", x[:-lag][same], x[lag:][same])
                    out.append((node[a][same], node[b][same], cosine, (own[a] == own[b])[same]))
            if out:
                a, b, c, s = (np.concatenate(z) for z in zip(*out, strict=True))
                a, b, c, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([c, c]), np.concatenate([s, s])
                yield _best(a, b, c, s, k)
            held = table.slice(max(0, table.num_rows - ahead))

    kind = nodes.schema["v"].dataType.simpleString()
    placed = nodes.select("node", "own", "part", "v").mapInArrow(tidy(place), f"node long, own long, part string, seed int, code long, at double, v {kind}")
    ordered = placed.repartition("part", "seed", "code").sortWithinPartitions("part", "seed", "code", "at", "node")
    return ordered.mapInArrow(tidy(compare), EDGES)


def ends_of_runs(keys: list[np.ndarray], edge: int) -> np.ndarray:
    """Marks all rows but those more than `edge` rows inside a run of equal keys."""
    n = len(keys[0])
    start = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([g[1:] != g[:-1] for g in keys])])) if n else np.zeros(0, dtype=np.int64)
    length = np.diff(np.append(start, n))
    place = np.arange(n) - np.repeat(start, length)
    return (place < edge) | (np.repeat(length, length) - place <= edge)


def _best(a: np.ndarray, b: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> pa.RecordBatch:
    """The k highest of each a, for those of its own component (s) and for others; a pair met several times counts once."""
    order = np.lexsort((b, a))
    first = order[np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])] if len(a) else order
    a, b, c, s = a[first], b[first], c[first], s[first]
    order = np.lexsort((b, -c, s, a))
    a, b, c, s = a[order], b[order], c[order], s[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    keep = rank < k
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(c[keep]), pa.array(s[keep])], names=["node", "other", "cosine", "same"])


def top(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each node inside and outside its component; partial aggregation removes repeats first."""
    once = edges.groupBy("node", "other", "same").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("node", "same").orderBy(F.desc("cosine"), "other"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def refine(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round: every node's neighbours, in both directions, are compared with one another."""
    both = top(graph.unionByName(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "cosine", "same")), 2 * k)
    lists = both.join(nodes.select(F.col("node").alias("other"), "own", "v"), "other").select("node", "other", "own", "v")

    def compare(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            node = table.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1])) if len(node) else 0
            yield from local(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from local(held)

    def local(table: pa.Table):
        if not table.num_rows:
            return
        node, other, own = table.column("node").to_numpy(), table.column("other").to_numpy(), table.column("own").to_numpy()
        x = _unit(table.column("v").combine_chunks()) if len(set(table.column("v").combine_chunks().value_lengths().to_pylist())) == 1 else None
        cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
        a, b, c, same = [], [], [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s < 2:
                continue
            y = x[s:e] if x is not None else _unit(table.column("v").slice(s, e - s).combine_chunks())
            sim = y @ y.T
            i, j = np.nonzero(~np.eye(e - s, dtype=bool))
            a.append(other[s:e][i])
            b.append(other[s:e][j])
            c.append(sim[i, j])
            same.append(own[s:e][i] == own[s:e][j])
        if a:
            yield _best(np.concatenate(a), np.concatenate(b), np.concatenate(c), np.concatenate(same), k)

    found = lists.repartition("node").sortWithinPartitions("node").mapInArrow(tidy(compare), EDGES)
    return top(graph.unionByName(found), k)


def descend(graph: DataFrame, nodes: DataFrame, n: int, k: int, rounds: int) -> DataFrame:
    for _ in range(rounds):
        better = written(refine(graph, nodes, k), True)
        changed = better.join(graph, ["node", "other"], "left_anti").count()
        graph = better
        if changed <= SETTLED * n * k:
            break
    return graph


def compare_blocks(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, n, root) of members (group, node, copies, v): links to a node in a pair of blocks, and the least node they join it with.

    A group is dealt into blocks by a hash and compared block against block, so no task holds more than two blocks.  A pair
    of blocks gives a row for each node that has a link there, however many links it has.
    """
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = members.join(sizes, "group").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = pairs.select("group", "node", "copies", "v", "i", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        x = np.array(rows["v"].tolist(), dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        copies, i, m = rows["copies"].to_numpy(), rows["i"].to_numpy(), len(x)
        across = rows["low"].iloc[0] != rows["high"].iloc[0]
        n, root, parts = np.zeros(m, dtype=np.int64), np.arange(m), []
        for a in range(0, m, SLICE):
            near = x[a : a + SLICE] @ x.T >= threshold
            near[np.arange(len(near)), a + np.arange(len(near))] = False
            if across:
                near &= i[a : a + SLICE, None] != i[None, :]
            n[a : a + SLICE] = near @ copies
            parts.append(np.packbits(near, axis=1))
        linked = np.vstack(parts)
        while True:  # the least node reachable: rows are in the order of nodes
            least = root.copy()
            for k in np.flatnonzero(n):
                least[k] = min(root[k], root[np.unpackbits(linked[k], count=m).view(bool)].min())
            least = least[least]
            if (least == root).all():
                break
            root = least
        some = n > 0
        node = rows["node"].to_numpy()
        return pd.DataFrame({"node": node[some], "n": n[some], "root": node[root[some]]})

    return written(placed.groupBy("group", "low", "high").applyInPandas(compare, "node long, n long, root long"), True)


def link_components(graph: DataFrame, nodes: DataFrame, k: int, threshold: float, seed: int) -> DataFrame:
    """(id, component) of the links at the threshold, those that saturated lists have no room for included."""
    linked = graph.filter((F.col("cosine") >= threshold) & (F.col("node") != F.col("other")))
    labels = components(linked.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    while True:
        full = written(linked.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("node"), True)
        n = full.count()
        if not n:
            return labels
        own = written(full.join(labels.select(F.col("id").alias("node"), F.col("component").alias("own")), "node"), True)
        among = nodes.drop("own").join(own, "node")
        known = graph.drop("same").join(own, "node").join(own.select(F.col("node").alias("other"), F.col("own").alias("its")), "other")
        known = known.select("node", "other", "cosine", (F.col("own") == F.col("its")).alias("same"))
        seeds = list(range(seed, seed + PROJECTIONS))
        seed += PROJECTIONS
        graph = written(top(known.unionByName(first_graph(among, n, seeds, k, AHEAD)), k), True)
        graph = descend(graph, among, n, k, ROUNDS)
        # the best neighbour outside is listed, so every component with such a link is merged
        linked = graph.filter(~F.col("same") & (F.col("cosine") >= threshold))
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(linked.select(F.col("node").alias("a"), F.col("other").alias("b"))))


def audit_recall(nodes: DataFrame, labels: DataFrame, threshold: float, sample: int = AUDIT, linked: int = AUDIT_LINKED) -> float:
    """The least share of true links, by brute force against all rows, whose ends are in one component.

    It is taken over a bounded sample of all rows and over one of linked rows, of their links and, so that large groups do not
    hide small ones, as the mean over the rows that have links.
    """
    every = nodes.orderBy(F.xxhash64(F.lit(1), "node")).limit(sample).select("node", "part", "v", F.lit(0).alias("draw"))
    some = labels.orderBy(F.xxhash64(F.lit(5), "id")).limit(linked).select(F.col("id").alias("node"))
    drawn = every.unionByName(nodes.join(F.broadcast(some), "node").select("node", "part", "v", F.lit(1).alias("draw"))).collect()
    draws = {d: {r["node"] for r in drawn if r["draw"] == d} for d in (0, 1)}
    drawn = list({r["node"]: r for r in drawn}.values())
    queries = [(r["node"], r["part"], np.asarray(r["v"], dtype=np.float64)) for r in drawn]
    by_part: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for p in {q[1] for q in queries}:
        x = np.array([q[2] for q in queries if q[1] == p])
        by_part[p] = (np.array([q[0] for q in queries if q[1] == p]), x / np.linalg.norm(x, axis=1, keepdims=True))

    def search(batches):
        for batch in batches:
            part, node = np.asarray(batch.column("part").to_pylist()), batch.column("node").to_numpy()
            for rows, x in _by_length(batch, "v"):
                for p in np.unique(part[rows]):
                    if p not in by_part:
                        continue
                    mine = rows[part[rows] == p]
                    q, y = by_part[p]
                    i, j = np.nonzero(x[part[rows] == p] @ y.T >= threshold)
                    i, j = i[node[mine[i]] != q[j]], j[node[mine[i]] != q[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(q[j]), pa.array(node[mine[i]])], names=["a", "b"])

    true = nodes.select("node", "part", "v").mapInArrow(tidy(search), "a long, b long")
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"))
    got = true.join(of("a"), "a", "left").join(of("b"), "b", "left").groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("component_a") == F.col("component_b")).alias("found")).collect()
    shares = [1.0]
    for held in draws.values():
        own = [(r["found"], r["n"]) for r in got if r["a"] in held]
        if own:
            shares += [sum(f for f, _ in own) / sum(n for _, n in own), sum(f / n for f, n in own) / len(own)]
    return min(shares)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, least_recall: float = LEAST_RECALL, extra: int = EXTRA) -> DataFrame:
    """Rows (vec_id, embedding, label) to (vec_id, n_links, component_id, kept, recall).

    recall: what the audit of the links found, the same in all rows; 1 where the blocks of each label were compared.
    """
    kind = rows.schema["embedding"].dataType
    if kind.elementType.typeName() not in ("float", "double"):
        kind = "array<double>"
    rows = rows.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), "label")
    nodes = nodes_of(rows)
    n = nodes.count()
    seeds = list(range(PROJECTIONS))
    graph = written(top(first_graph(nodes, n, seeds, k, AHEAD), k), True)
    for turn in range(extra + 1):
        graph = descend(graph, nodes, n, k, ROUNDS)
        labels = link_components(graph, nodes, k, threshold, (turn + 1) << 16)
        recall = audit_recall(nodes, labels, threshold)
        if recall >= least_recall:
            members = labels.select(F.col("component").alias("group"), F.col("id").alias("node")).join(nodes.select("node", "copies", "v"), "node")
            counts = compare_blocks(members, threshold)
            break
        if turn < extra:
            more = [PROJECTIONS * (turn + 1) + s for s in range(PROJECTIONS)]
            graph = written(top(graph.unionByName(first_graph(nodes, n, more, k, AHEAD)), k), True)
    else:
        counts, recall = compare_blocks(nodes.select(F.col("part").alias("group"), "node", "copies", "v"), threshold), 1.0
        labels = components(counts.select(F.col("root").alias("a"), F.col("node").alias("b")))

    linked = counts.groupBy("node").agg(F.sum("n").alias("n"))
    about = nodes.select("node", "label", "v", "first_id", "copies").join(labels.withColumnRenamed("id", "node"), "node", "left").join(linked, "node", "left")
    about = written(about.withColumn("component", F.coalesce("component", "node")), True)
    least = about.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # written, so that the join can split the rows of a vector with very many copies
    about = written(about.join(least, "component").select("label", F.col("v").alias("embedding"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), True)
    out = rows.join(about, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id").cast("long")
    return out.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        F.lit(recall).alias("recall"),
    )
