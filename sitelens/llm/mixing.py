"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get whole blocks of tokens by highest quotients, then hash shards of each source get them in the same way.  Documents
of a shard lie on one line of tokens in seeded order; a keyed Feistel permutation of its blocks says which of them are
taken, so nothing is held for a block.  What whole blocks leave of a source's target is one cut block.

Edge cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, ordered last;
repeated rows are separate documents; null ids are ids like any other; equal quotients go to the earlier source or shard; a
source without words has target 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written
from .textblocks import Words, text_blocks
from .training_order import feistel

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_TOKENS = 256
DOCS_PER_SHARD = 512
#: Bounds the table of (source, shard) cells that the driver apportions, one more for each source; shards grow beyond it, not the table.
MAX_CELLS = 262_144
#: The table of sources is sent to all executors up to so many; beyond it, it is joined by a shuffle.
MOST_SENT = 100_000
SEED = 17


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Share the total of all sizes by weight; a target above max_repeat x its size is cut and the excess reshared by weight."""
    size, weight = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    out, free, left = np.zeros(len(size)), np.ones(len(size), dtype=bool), size.sum()
    while free.any():
        share = left * weight / weight[free].sum()
        over = free & (share > max_repeat * size)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = max_repeat * size[over]
        left -= out[over].sum()
        free &= ~over
    return out.tolist()


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> np.ndarray:
    """Seats to the highest quotients votes / (2 * held + 1), none above its cap; ties go to the earlier entry.

    The divisor form of the rule, floor(votes / divisor + 1/2), gives nearly all seats at once, at a divisor a little too
    high; the last ones go one by one to the highest quotient left, compared as fractions.
    """
    v, cap = np.asarray(votes, dtype=float), np.asarray(caps, dtype=np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return np.zeros(len(v), dtype=np.int64)

    def held(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(v / divisor + 0.5), cap).astype(np.int64)

    low, high = v[v > 0].min() / (2.0 * seats + 2), 4 * v.max() + 1
    while held(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if held(middle).sum() > seats else (low, middle)
    got = held(high * (1 + 1e-9))
    exact = [Fraction(x) for x in votes]
    queue = [(-exact[i] / (2 * int(got[i]) + 1), i) for i in range(len(v)) if got[i] < cap[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(queue, (-exact[i] / (2 * int(got[i]) + 1), i))
    return got


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of words of each whole text."""
    schema = "doc_id long, source string, size long"

    def count(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, dtype=np.int64)
            for first, data, offsets in text_blocks(batch.column("text")):
                size[first : first + len(offsets) - 1] = Words(data, offsets, lower=False).count
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size)], names=["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), schema)


def cell_quotas(sizes: Sequence[int], blocks: int, tokens: int, block: int, max_repeat: int) -> np.ndarray:
    """Tokens taken of each shard of a source: whole blocks by Sainte-Lague, then the difference to the source's tokens."""
    size = np.asarray(sizes, dtype=np.int64)
    most = max_repeat * size
    quota = np.minimum(sainte_lague(size, blocks, -(-most // block)) * block, most)
    for more, room in ((1, most - quota), (-1, quota)):
        left = max(0, more * (tokens - int(quota.sum())))
        before = np.cumsum(room) - room
        quota = quota + more * np.clip(left - before, 0, room)
    return quota


def blocks_taken(first: int, last: int, total: int, rest: int, block: int, key: int) -> np.ndarray:
    """Tokens taken of the blocks first to last of a line of `total` tokens of which `rest` are taken.

    Whole blocks are taken in the order of a keyed permutation, the next of them is cut; an incomplete block at the end is last.
    """
    n, b = total // block, np.arange(first, last + 1)
    out = np.zeros(len(b), dtype=np.int64)
    whole = b < n
    if whole.any():
        slot = feistel(b[whole], n, key)
        out[whole] = np.where(slot < rest // block, block, np.where(slot == rest // block, rest % block, 0))
    out[b == n] = max(0, rest - n * block)
    return out


def taken_tokens(start: int, size: np.ndarray, total: int, quota: int, block: int, key: int) -> np.ndarray:
    """Tokens taken of consecutive documents that begin at `start` of the line: whole rounds of all, and blocks for the rest."""
    if not total or not len(size):
        return np.zeros(len(size), dtype=np.int64)
    rounds, rest = divmod(quota, total)
    edge = start + np.concatenate([[0], np.cumsum(size)])
    amount = blocks_taken(int(edge[0]) // block, int(edge[-1]) // block, total, rest, block, key)
    before, at = np.concatenate([[0], np.cumsum(amount)]), edge // block - int(edge[0]) // block
    return rounds * size + np.diff(before[at] + np.minimum(edge % block, amount[at]))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    block_tokens: int = BLOCK_TOKENS,
    docs_per_shard: int = DOCS_PER_SHARD,
    seed: int = SEED,
) -> DataFrame:
    """Documents (doc_id, text, source) to (doc_id, source, size, source_size, target, taken).

    Only (doc_id, size) rows are shuffled; a task reads its shards as a stream.  The driver holds one row for each source
    and one for each cell, at most MAX_CELLS more than there are sources.
    """
    sizes = written(document_sizes(docs))
    by_source = sorted(
        sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(),
        key=lambda r: (r["source"] is None, r["source"] or ""),
    )
    weight = [float(weights[i % len(weights)]) for i in range(len(by_source))]
    target = targets([r["size"] for r in by_source], weight, max_repeat)
    per_shard = max(docs_per_shard, -(-sum(r["n"] for r in by_source) // MAX_CELLS))
    shards = [-(-r["n"] // per_shard) for r in by_source]
    first_cell = np.cumsum([0, *shards])
    place = sizes.sparkSession.createDataFrame(
        [(i, r["source"], shards[i], int(first_cell[i])) for i, r in enumerate(by_source)], "source_no int, source_key string, shards int, first_cell int"
    )
    if len(by_source) <= MOST_SENT:
        place = F.broadcast(place)
    placed = sizes.join(place, F.col("source").eqNullSafe(F.col("source_key"))).select(
        "doc_id",
        "size",
        F.xxhash64(F.lit(seed + 1), "doc_id").alias("at"),
        "source_no",
        (F.col("first_cell") + F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards"))).cast("int").alias("cell"),
    )
    of_source = defaultdict(list)
    for r in placed.groupBy("source_no", "cell").agg(F.sum("size").alias("size")).collect():
        of_source[r["source_no"]].append((r["cell"], r["size"]))

    blocks = [sum(-(-max_repeat * size // block_tokens) for _, size in of_source[i]) for i in range(len(by_source))]
    seats = sainte_lague(target, round(sum(target) / block_tokens), blocks)
    total, quota = (np.zeros(int(first_cell[-1]), dtype=np.int64) for _ in range(2))
    for i in range(len(by_source)):
        cells = np.array(sorted(of_source[i]), dtype=np.int64).reshape(-1, 2)
        total[cells[:, 0]] = cells[:, 1]
        quota[cells[:, 0]] = cell_quotas(cells[:, 1], int(seats[i]), round(target[i]), block_tokens, max_repeat)
    names = pa.array([r["source"] for r in by_source], pa.string())
    whole, goal = np.array([r["size"] or 0 for r in by_source], dtype=np.int64), np.array(target, dtype=float)

    def take(batches):
        cell_now, at = -1, 0  # where the line of the last cell goes on
        for batch in batches:
            cell, size, number = (batch.column(c).to_numpy() for c in ("cell", "size", "source_no"))
            taken = np.zeros(len(cell), dtype=np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                c = int(cell[a])
                at = at if c == cell_now else 0
                taken[a:b] = taken_tokens(at, size[a:b], int(total[c]), int(quota[c]), block_tokens, seed + c)
                cell_now, at = c, at + int(size[a:b].sum())
            columns = [batch.column("doc_id"), names.take(pa.array(number)), batch.column("size"), pa.array(whole[number]), pa.array(goal[number]), pa.array(taken)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "size", "source_size", "target", "taken"])

    schema = "doc_id long, source string, size long, source_size long, target double, taken long"
    return placed.repartition("cell").sortWithinPartitions("cell", "at", "doc_id", "size").mapInArrow(tidy(take), schema)
