"""Removal of repeated byte strings: ranks of sampled positions, compared at growing lengths until unique or decided.

A window is a string of `length` bytes.  Ranks of all positions would be some forty times the input, so positions are
sampled by content: each window is represented by the smallest hash among its strings of KGRAM bytes (its anchor), which equal
windows share wherever they are.  Windows of one anchor form a segment, about sixty of them.

 1. Rank by the first KGRAM bytes at the anchor: Spark counts equal ranks and segments of a unique rank leave.
 2. Rank the rest by the longer string that spans all windows of the segment: where two are equal all their windows repeat.
 3. Segments still unique at that length may share some of their windows with others of their rank.  In small groups their
    surroundings are compared directly; in large ones the window at each position is ranked by itself.

Ranks that decide alone (2. and 3.) are 64 bits of BLAKE2b and go with the first (1.); that of 1. is a fast hash, which only chooses what is compared.  A passage that very many
texts have is one rank; each table joined on ranks is written first and has no other work in its stage, so that a join may
split the rows of such a rank.

Edge cases: null and empty texts have nothing removed; texts shorter than a window cannot repeat; matches do not cross
documents but may overlap themselves; repeated rows repeat wholly; strings are judged on the input; ids may be null or
repeat; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, tidy, written
from .textblocks import RangeHash, as_long, span_digests, text_blocks

LENGTH = 200
KGRAM = 64
#: Ranks of up to so many different segments are compared side by side, larger ones position by position.
SIDE_BY_SIDE = 16


def segments(data: np.ndarray, offsets: np.ndarray, length: int, kgram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, rank of the anchor, rank of the whole) of the segments of a block."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    ranges = RangeHash(data)
    at = np.arange(n - kgram + 1)
    rank = ranges.of(at, at + kgram)
    low, where, span, step = rank, at, length - kgram + 1, 1
    while 2 * step <= span:  # the smallest of 2, 4, 8 ... neighbours, then of the whole span; the leftmost on ties
        low, where, step = *_lower(low[:-step], where[:-step], low[step:], where[step:]), 2 * step
    if rest := span - step:
        low, where = _lower(low[:-rest], where[:-rest], low[rest:], where[rest:])
    window = np.arange(n - length + 1)
    doc = np.searchsorted(offsets, window, side="right") - 1
    whole = window + length <= offsets[doc + 1]
    window, doc, anchor = window[whole], doc[whole], where[: n - length + 1][whole]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])) if len(window) else np.zeros(0, dtype=np.int64)
    first, last = window[new], window[np.append(new[1:], len(window)) - 1]
    return doc[new], first, last, anchor[new], rank[anchor[new]], span_digests(data, first, last + length)


def _lower(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    take = b < a
    return np.where(take, b, a), np.where(take, at_b, at_a)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with d1, d2: 128 bits that stand for the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"d1": F.xxhash64(text, F.lit(1)), "d2": F.xxhash64(F.lit(2), text)})


def segment_table(docs: DataFrame, length: int, kgram: int) -> DataFrame:
    """(d1, d2, k, s, at): text, rank of the anchor, rank of the whole, and first << 16 | windows - 1 << 8 | anchor - first."""

    def run(batches):
        for batch in batches:
            d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
            for row, data, offsets in text_blocks(batch.column("text")):
                doc, first, last, anchor, k, s = segments(data, offsets, length, kgram)
                at = ((first - offsets[doc]) << 16) | ((last - first) << 8) | (anchor - first)
                yield pa.RecordBatch.from_arrays([pa.array(d1[row + doc]), pa.array(d2[row + doc]), pa.array(as_long(k)), pa.array(as_long(s)), pa.array(at)], names=["d1", "d2", "k", "s", "at"])

    long_enough = docs.filter(F.octet_length("text") >= length)
    return long_enough.select("d1", "d2", "text").mapInArrow(tidy(run), "d1 long, d2 long, k long, s long, at long")


def surroundings(docs: DataFrame, wanted: DataFrame, length: int, kgram: int) -> DataFrame:
    """wanted (d1, d2, at, ...) with `left` and `right`: the bytes before and from the anchor that its windows can reach."""
    reach = length - kgram

    def run(batches):
        for batch in batches:
            text, at = batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("at").to_numpy()
            left, right = [], []
            for t, packed in zip(text, at.tolist(), strict=True):
                anchor = (packed >> 16) + (packed & 255)
                left.append(t[max(0, anchor - reach) : anchor])
                right.append(t[anchor : anchor + length])
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=[*names, "left", "right"])

    names = wanted.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in wanted.dtypes) + ", left binary, right binary"
    joined = docs.filter(F.octet_length("text") >= length).select("d1", "d2", "text").join(wanted, ["d1", "d2"])
    # copies of a text give equal rows: one is enough
    return joined.mapInArrow(tidy(run), schema).groupBy("k", "s").agg(*[F.first(c).alias(c) for c in [*[c for c in names if c not in ("k", "s")], "left", "right"]])


def side_by_side(near: DataFrame, length: int, kgram: int) -> DataFrame:
    """(d1, d2, first, last): windows of unique segments that also occur in another segment of their rank; groups are small."""
    reach = length - kgram

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            k = table.column("k").to_numpy()
            last = int(np.flatnonzero(k == k[-1])[0]) if len(k) else 0
            yield from compare(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from compare(held)

    def compare(table: pa.Table):
        if not table.num_rows:
            return
        k, c, at, d1, d2 = (table.column(x).to_numpy() for x in ("k", "c", "at", "d1", "d2"))
        left, right = table.column("left").to_pylist(), table.column("right").to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        out: list[tuple[int, int, int, int]] = []
        shift = np.arange(reach + 1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = b - a
            before = np.repeat(-1 - np.arange(m, dtype=np.int16)[:, None], reach, axis=1)  # beyond a text nothing is equal
            after = np.repeat(-1 - np.arange(m, dtype=np.int16)[:, None], length, axis=1)
            for i in range(m):
                x, y = np.frombuffer(left[a + i], dtype=np.uint8), np.frombuffer(right[a + i], dtype=np.uint8)
                before[i, : len(x)], after[i, : len(y)] = x[::-1], y
            for i in np.flatnonzero(c[a:b] == 1):
                others = np.arange(m) != i
                backward = np.logical_and.accumulate(before[others] == before[i], axis=1).sum(axis=1)
                forward = np.logical_and.accumulate(after[others] == after[i], axis=1).sum(axis=1)
                packed = int(at[a + i])
                windows, to_anchor = (packed >> 8) & 255, packed & 255
                repeat = ((shift <= backward[:, None]) & (length - shift <= forward[:, None])).any(axis=0)
                start = to_anchor - np.flatnonzero(repeat)  # relative to the first window
                start = np.sort(start[(start >= 0) & (start <= windows)])
                for run_ in np.split(start, np.flatnonzero(np.diff(start) > 1) + 1) if len(start) else ():
                    out.append((int(d1[a + i]), int(d2[a + i]), (packed >> 16) + int(run_[0]), (packed >> 16) + int(run_[-1])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["d1", "d2", "first", "last"])

    ordered = near.select("k", "c", "d1", "d2", "at", "left", "right").repartition("k").sortWithinPartitions("k")
    return ordered.mapInArrow(tidy(run), "d1 long, d2 long, first long, last long")


def by_position(near: DataFrame, length: int, kgram: int) -> DataFrame:
    """The same for ranks of many segments: every window is ranked by itself and equal ranks are counted."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("k", "c", "d1", "d2", "at", "left", "right")]
            for k, c, d1, d2, packed, left, right in zip(*columns, strict=True):
                data = np.frombuffer(left + right, dtype=np.uint8)
                first = len(left) - (packed & 255) + np.arange(((packed >> 8) & 255) + 1)
                n = len(first)
                h = span_digests(data, first, first + length)
                arrays = [np.full(n, v, dtype=np.int64) for v in (k, c, d1, d2)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array((packed >> 16) + np.arange(n)), pa.array(as_long(h))], names=["k", "c", "d1", "d2", "first", "h"])

    windows = near.select("k", "c", "d1", "d2", "at", "left", "right").mapInArrow(tidy(run), "k long, c long, d1 long, d2 long, first long, h long")
    again = written(windows.groupBy("k", "h").agg(F.count("*").alias("n")).filter("n > 1").select("k", "h"), True)
    return windows.filter("c = 1").join(again, ["k", "h"]).select("d1", "d2", "first", F.col("first").alias("last"))


def repeated_windows(docs: DataFrame, length: int, kgram: int, small: int = SIDE_BY_SIDE) -> DataFrame:
    """(d1, d2, starts): for each text that has any, the runs (first, last) of starts of windows that occur more than once."""
    all_segments = written(segment_table(docs, length, kgram))
    ranks = written(all_segments.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), True)
    left = written(all_segments.join(ranks, "k"))
    groups = written(left.groupBy("k", "s").agg(F.count("*").alias("c"), F.min(F.struct("d1", "d2", "at")).alias("where")))
    discard(all_segments)

    whole = left.join(groups.filter("c > 1").select("k", "s"), ["k", "s"]).select(
        "d1", "d2", F.shiftright("at", 16).alias("first"), (F.shiftright("at", 16) + F.shiftright("at", 8).bitwiseAND(F.lit(255))).alias("last")
    )
    undecided = groups.groupBy("k").agg(F.count("*").alias("m"), F.count_if(F.col("c") == 1).alias("unique")).filter("m > 1 and unique > 0").select("k", "m")
    undecided = written(undecided, True)
    wanted = groups.join(undecided, "k").select("k", "s", "c", "m", "where.*")
    near = written(surroundings(docs, wanted, length, kgram), True)
    parts = side_by_side(near.filter(F.col("m") <= small), length, kgram).unionByName(by_position(near.filter(F.col("m") > small), length, kgram))
    runs = whole.unionByName(parts).distinct()
    starts = written(runs.groupBy("d1", "d2").agg(F.collect_list(F.struct("first", "last")).alias("starts")), True)
    for done in (ranks, left, groups, undecided, near):
        discard(done)
    return starts


def remove_repeats(docs: DataFrame, length: int = LENGTH, kgram: int | None = None) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, n_bytes, spans: array of (start, end) removed, kept: the remaining bytes)."""
    kgram = kgram or min(KGRAM, max(1, length // 3))
    assert length - kgram < 256, "positions within a segment are packed in a byte"
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = repeated_windows(docs, length, kgram)

    def run(batches):
        for batch in batches:
            n, spans, kept = [], [], []
            for t, starts in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("starts").to_pylist(), strict=True):
                t = t or b""
                merged: list[list[int]] = []
                for a, b in sorted((x["first"], x["last"] + length) for x in starts or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edge = [0, *(x for span in merged for x in span), len(t)]
                n.append(len(t))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = docs.join(found, ["d1", "d2"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
