"""Removal of repeated passages of words by recompression: runs and pairs of symbols get global names, round after round.

Words are the first symbols.  A round of runs gives what lies inside each maximal run of one symbol a name of that symbol and its number; a round of
pairs tosses a coin for each symbol, by its name, and gives each pair of a heads and a tails symbol a name.  A name is a digest of
what it stands for, so equal strings get equal names in every task without being dealt out by a sort, and equal passages get equal
symbols in their interior: all but the symbols at either end, which what stands around a passage may draw into a run or pair.

 1. Each window of words is represented by one interior symbol of the highest level at which it has any: the longest, then the one
    of smallest name, then the leftmost.  That depends on the window's words alone.  Consecutive windows of one symbol form
    a segment, some five of them.
 2. Spark counts symbols by name: those of one document only leave.  What is shared is what repeats, near enough.
 3. Segments of one symbol whose windows together have equal words repeat wholly, but in their first document.
 4. Where one symbol has segments of different words, these share some windows at most: those of the first document of each kind
    are read again, each of their windows is named by its words, and equal windows are counted.

Names decide nothing but what is compared: 3. and 4. go by 64 bits of BLAKE2b over the 128 bits of each word, besides the
name; words are hashed under a key of the run.  A
passage that very many texts have is one name; each table joined on names is written first and has no other work in its stage, so
that a join may split the rows of such a name.

Edge cases: null and empty texts have no words; texts of fewer words than a window lose nothing; a null id neither loses nor takes
words; rows of one id don't take words from each other; windows may overlap; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, tidy, written
from .textblocks import Words, as_long, mix, secret_key, span_digests, text_blocks

WINDOW = 13
#: Rounds of pairs after the round of runs: symbols of three to five words, of which a window has one inside.
ROUNDS = 3

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


class Level:
    """Symbols of one level over a block of texts: names, first words, and the interior that each start and end of a window leaves."""

    def __init__(self, name: np.ndarray, start: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray):
        #: left[i]: first interior symbol of windows that start at word i; right[j]: the one after the last of those that end before word j
        self.name, self.start, self.doc, self.left, self.right = name, start, doc, left, right

    def merged(self, goes_on: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> Level:
        """The level above, where symbols that go on another's are part of it; left, right: interiors as symbols of this level."""
        keep = ~goes_on
        place = np.append(np.cumsum(keep) - 1, keep.sum())
        return Level(name[keep], self.start[keep], self.doc[keep], place[left], place[right])

    def runs(self) -> Level:
        """What lies between the ends of a maximal run of one symbol is named by its length.

        The ends stay symbols of their own, so at either end of a window a symbol is the same whether or not its run goes on
        outside; of a run that begins in a window's end only that end is known.
        """
        n, name, place = len(self.name), self.name, np.arange(len(self.name))
        again = np.zeros(n, dtype=bool)
        again[1:] = (name[1:] == name[:-1]) & (self.doc[1:] == self.doc[:-1])
        start = np.flatnonzero(~again)
        run = np.cumsum(~again) - 1
        first, last = start[run], (np.append(start[1:], n) - 1)[run]
        inner = last - first - 1
        head = (place == first + 1) & (inner > 1)
        named = name.copy()
        named[head] = mix(name[head] * np.uint64(0x9FB21C651E98DF25) + inner[head].astype(np.uint64))
        left, right = np.append(last, n)[self.left], np.where(self.right > 0, first[np.maximum(self.right - 1, 0)] + 1, 0)
        return self.merged((place > first + 1) & (place < last), named, left, right)

    def pairs(self, level: int) -> Level:
        """Heads followed by tails are named; tails at the start of a window, or heads at its end, may pair with what is outside."""
        n, name = len(self.name), self.name
        heads = np.append((mix(name + np.uint64(level * 0x1000003)) >> np.uint64(40)) & np.uint64(1) == 0, False)
        second = np.zeros(n, dtype=bool)
        second[1:] = heads[: n - 1] & ~heads[1:n] & (self.doc[1:] == self.doc[:-1])
        named, first = name.copy(), np.flatnonzero(second) - 1
        named[first] = mix(name[first] * np.uint64(0x9FB21C651E98DF25) + mix(name[first + 1] + np.uint64(level)))
        left = np.minimum(self.left + ~heads[self.left], n)
        right = self.right - ((self.right > 0) & heads[self.right - 1])
        return self.merged(second, named, left, right)


def segments(words: Words, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, name) of each segment of a block; windows by their first word in the block."""
    digest, doc, n = words.digests[:, 0], words.doc, len(words.doc)
    if n < window:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    start = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    levels = [Level(digest, np.arange(n), doc, np.arange(n), np.arange(n + 1))]
    levels.append(levels[0].runs())
    for i in range(rounds):
        levels.append(levels[-1].pairs(i + 1))
    where, name = np.full(len(start), -1), np.zeros(len(start), dtype=np.uint64)
    open_ = np.arange(len(start))
    for number, level in reversed(list(enumerate(levels))):
        left, right = level.left[start[open_]], level.right[start[open_] + window]
        inside = left < right
        at, left, right = open_[inside], left[inside], right[inside]
        open_ = open_[~inside]
        if not len(at):
            continue
        length = np.minimum(np.diff(np.append(level.start, n)), 15).astype(np.uint64)
        order = ((np.uint64(15) - length) << np.uint64(60)) | (mix(level.name ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(4))
        best, low = left.copy(), order[left]
        for step in range(1, int((right - left).max())):
            more = np.flatnonzero(left + step < right)
            value = order[left[more] + step]
            less = value < low[more]
            best[more[less]], low[more[less]] = left[more[less]] + step, value[less]
        where[at] = level.start[best] * len(levels) + number
        name[at] = mix(level.name[best] + np.uint64(number))
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (np.diff(start) != 1)])) if len(start) else np.zeros(0, dtype=np.int64)
    last = np.append(new[1:], len(start)) - 1 if len(new) else new
    return doc[start[new]], start[new], start[last], name[new]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, h, text): h tells rows of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def segment_table(docs: DataFrame, window: int, rounds: int, key: tuple[int, int]) -> DataFrame:
    """(k, s, doc, h, at): name of the symbol, digest of all words of the segment, document, and first << 8 | windows - 1."""

    def run(batches):
        for batch in batches:
            ids, h = batch.column("doc").to_numpy(), batch.column("h").to_numpy()
            for row, data, offsets in text_blocks(batch.column("text")):
                words = Words(data, offsets, lower=False, key=key)
                doc, first, last, name = segments(words, window, rounds)
                s = as_long(span_digests(words.digests, first, last + window, 16))
                at = ((first - words.first[doc]) << 8) | (last - first)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(name)), pa.array(s), pa.array(ids[row + doc]), pa.array(h[row + doc]), pa.array(at)], names=["k", "s", "doc", "h", "at"])

    long_enough = docs.filter(F.col("doc").isNotNull() & (F.length("text") >= 2 * window - 1))
    return long_enough.mapInArrow(tidy(run), "k long, s long, doc long, h long, at long")


def windows_of(docs: DataFrame, wanted: DataFrame, window: int, key: tuple[int, int]) -> DataFrame:
    """(k, w, doc, h, first): each window of the wanted segments (k, doc, h, at), named by its words."""

    def run(batches):
        for batch in batches:
            ids, h, asked = (batch.column(c).to_pylist() for c in ("doc", "h", "asked"))
            for row, data, offsets in text_blocks(batch.column("text")):
                words = Words(data, offsets, lower=False, key=key)
                k, first, end, own = [], [], [], []
                for i in range(len(offsets) - 1):
                    base = int(words.first[i])
                    for one in asked[row + i]:
                        a = one["at"] >> 8
                        for p in range(a, a + (one["at"] & 255) + 1):
                            k.append(one["k"])
                            first.append(base + p)
                            own.append(row + i)
                first_ = np.array(first, dtype=np.int64)
                w = as_long(span_digests(words.digests, first_, first_ + window, 16))
                place = first_ - words.first[np.array(own, dtype=np.int64) - row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(w), pa.array([ids[i] for i in own], pa.int64()), pa.array([h[i] for i in own], pa.int64()), pa.array(place)], names=["k", "w", "doc", "h", "first"]
                )

    asked = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("k", "at")).alias("asked"))
    # rows equal in id and text give the same windows again, which changes neither the least id nor what is removed
    joined = docs.join(asked, ["doc", "h"]).select("doc", "h", "text", "asked")
    return joined.mapInArrow(tidy(run), "k long, w long, doc long, h long, first long")


def repeated_windows(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """(doc, h, starts): for each text that has any, the runs (first, last) of windows that a document of a smaller id also has."""
    key = secret_key()
    all_segments = written(segment_table(docs, window, rounds, key))
    names = all_segments.groupBy("k").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("k")
    names = written(names, True)
    left = written(all_segments.join(names, "k"))
    discard(all_segments)
    discard(names)
    kinds = written(left.groupBy("k", "s").agg(F.min("doc").alias("low")))
    placed = written(left.join(kinds, ["k", "s"]).select("k", "doc", "h", "at", "low"))
    discard(left)
    first, last = F.shiftright("at", 8), F.shiftright("at", 8) + F.col("at").bitwiseAND(F.lit(255))
    whole = placed.filter("doc > low").select("doc", "h", first.alias("first"), last.alias("last"))
    several = kinds.groupBy("k").agg(F.min("low").alias("least"), F.max("low").alias("most")).filter("least < most").select("k")
    several = written(several, True)
    wanted = placed.filter("doc = low").select("k", "doc", "h", "at").join(several, "k")
    named = written(windows_of(docs, wanted, window, key))
    least = written(named.groupBy("k", "w").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("k", "w", "low"), True)
    parts = named.join(least, ["k", "w"]).filter("doc > low").select("doc", "h", "first", F.col("first").alias("last"))
    starts = written(whole.unionByName(parts).groupBy("doc", "h").agg(F.collect_list(F.struct("first", "last")).alias("starts")), True)
    for done in (kinds, placed, several, named, least):
        discard(done)
    return starts


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, n_words, n_removed, spans: array of word places (start, end) removed, kept: the other words, joined by one space)."""
    assert 1 < window < 256, "windows of a segment are counted in a byte"
    keyed = _keyed(docs)
    starts = repeated_windows(keyed, window, rounds)

    def run(batches):
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for text, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words, merged = text.split(), []
                for a, b in sorted((x["first"], x["last"] + window) for x in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edge = [0, *(x for span in merged for x in span), len(words)]
                n.append(len(words))
                gone.append(sum(b - a for a, b in merged))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b" ".join(w for a, b in zip(edge[::2], edge[1::2], strict=True) for w in words[a:b]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    joined = keyed.join(starts, ["doc", "h"], "left").select("doc", "text", "starts")
    return joined.mapInArrow(tidy(run), SCHEMA)
