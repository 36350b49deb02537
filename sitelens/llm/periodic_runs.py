"""Periodic runs of words by online dyadic square catching.

A square is a stretch of words followed at once by itself.  A catcher holds one completed block of 2**j words that starts at
a multiple of 2**j.  As words are appended, each position whose next 2**j words are complete is compared with the
block before its own, which is between 2**j and 2**(j+1) - 1 words back: where both have equal names, a square of that period is
caught.  Names of 2**(j+1) words are made of two names of 2**j words, so all periods cost a few operations for each word and
level.  A square is verified on the words themselves while its suffix comparisons run backward and forward; further squares of
the same period merge into the run that this gives, and a run that reaches the last word stays open and is carried on by
the words appended next.  Longer periods that are multiples of a run's own lie inside that run and are dropped.

A run as reported has at least `times` (3 or more) periods and `least` words.  One of 4 and more periods is caught by two
catchers in a row, which is asked for before a square is verified, so prose costs next to nothing beyond its names.

Edge cases: null and empty texts have no words and no runs; repeated rows and null ids are rows like any other; a very long
text is appended in parts; of equally good runs the first is the best, then the shortest period; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy
from .textblocks import mix

#: A run has at least so many periods and so many words.
TIMES, LEAST = 4, 6
#: Words of short texts are appended together up to so many, those of a longer text in such parts.
APPEND = 1 << 17

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"


class Catchers:
    """Runs of a growing row of words (numbers); append() may be called with any number of words at a time."""

    def __init__(self, times: int = TIMES, least: int = LEAST, longest: int | None = None):
        """longest: no run has more words, so longer periods aren't watched for."""
        assert times >= 3, "a shorter run may hold no whole catcher and its repeat"
        self.times, self.least, self.longest = times, least, longest
        self.words, self.n = np.zeros(1 << 10, dtype=np.int64), 0
        self.names: list[np.ndarray] = []  # of each level the last names, from position self.at on
        self.at: list[int] = []
        self.closed: list[tuple[int, int, int]] = []  # (start, end, period)
        self.open: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        if self.n + len(words) > len(self.words):
            self.words = np.concatenate([self.words[: self.n], np.zeros(max(len(words), self.n), dtype=np.int64)])
        self.words[self.n : self.n + len(words)] = words
        before, self.n = self.n, self.n + len(words)
        carried, self.open = self.open, []
        for start, end, period in carried:
            self._keep(start, self._forward(end, period), period)
        level = 0
        while self.times << level <= min(self.n, self.longest or self.n):
            self._level(level, before)
            level += 1
        for level, (at, names) in enumerate(zip(self.at, self.names, strict=True)):
            keep = (self.n - (5 << level)) & -(1 << level)  # the catchers that the next words may meet
            if keep > at + (8 << level):
                self.names[level], self.at[level] = names[keep - at :].copy(), keep

    def runs(self) -> np.ndarray:
        """Rows (start, end, period) by start, then period, if no more words come."""
        found = self.closed + [r for r in self.open if self._long(*r)]
        return np.array(sorted(found, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)

    def _long(self, start: int, end: int, period: int) -> bool:
        return end - start >= max(self.least, self.times * period)

    def _keep(self, start: int, end: int, period: int) -> None:
        if end == self.n:
            self.open.append((start, end, period))
        elif self._long(start, end, period):
            self.closed.append((start, end, period))

    def _level(self, level: int, before: int) -> None:
        """Names of the positions completed by the last words, and the squares they catch."""
        width = 1 << level
        if level == len(self.names):
            self.names.append(np.zeros(0, dtype=np.uint64))
            self.at.append(0)
        at, names = self.at[level], self.names[level]
        done = at + len(names)
        if level == 0:
            new = mix(self.words[done : self.n].view(np.uint64) + np.uint64(1))
        else:
            below, low, half = self.names[level - 1], self.at[level - 1], width >> 1
            n = self.n - width + 1
            new = mix(below[done - low : n - low] * np.uint64(0x9FB21C651E98DF25) + below[done - low + half : n - low + half])
        self.names[level] = names = np.concatenate([names, new])
        first = max(width, done - width)
        where = np.arange(first, at + len(names))
        head = ((where >> level) - 1) << level
        same = names[first - at :] == names[head - at]
        caught = same.copy()
        if self.times > 3:
            caught[:width] = False
            caught[width:] &= same[:-width]
        hit = np.flatnonzero(caught)
        if len(hit):
            self._merge(head[hit], where[hit], width)

    def _merge(self, head: np.ndarray, where: np.ndarray, width: int) -> None:
        """Verified squares become runs; head ascends."""
        period, left = where - head, np.ones(len(head), dtype=bool)

        def inside(start: int, end: int, q: int) -> None:
            a, b = np.searchsorted(head, [start, end])
            left[a:b] &= (where[a:b] + width > end) | (period[a:b] % q != 0)

        for run in (*self.closed, *self.open):
            if run[1] > head[0]:
                inside(*run)
        while left.any():
            i = int(np.argmax(left))
            left[i] = False
            q, start = int(period[i]), int(head[i])
            end = self._forward(start + q, q)
            if end >= where[i] + width:  # else only the names were equal
                start = self._backward(start, q)
                self._keep(start, end, q)
                inside(start, end, q)

    def _forward(self, end: int, period: int) -> int:
        """The first place from `end` on whose word isn't the one a period before."""
        words, step = self.words, 16
        while end < self.n:
            stop = min(self.n, end + step)
            differ = words[end:stop] != words[end - period : stop - period]
            if differ.any():
                return end + int(np.argmax(differ))
            end, step = stop, 2 * step
        return self.n

    def _backward(self, start: int, period: int) -> int:
        """The first place such that from it to `start` each word is the one a period after."""
        words, step = self.words, 16
        while start > 0:
            stop = max(0, start - step)
            differ = words[stop:start] != words[stop + period : start + period]
            if differ.any():
                return start - int(np.argmax(differ[::-1]))
            start, step = stop, 2 * step
        return 0


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, from 0."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if words else np.zeros(0, dtype=np.int64)


def runs_of(texts: list[list[bytes]], times: int = TIMES, least: int = LEAST) -> list[np.ndarray]:
    """Rows (start, end, period) of the runs of each text; texts are kept apart by numbers that occur once."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(length + 1) - length - 1
    row = np.empty(int(length.sum()) + len(texts), dtype=np.int64)
    apart = np.zeros(len(row), dtype=bool)
    apart[first + length] = True
    row[~apart] = numbered([w for t in texts for w in t])
    row[apart] = -2 - np.arange(len(texts))
    held = Catchers(times, least, int(length.max(initial=0)))
    for a in range(0, len(row), APPEND):
        held.append(row[a : a + APPEND])
    found = held.runs()
    cuts = np.searchsorted(found[:, 0], np.append(first, len(row)))
    return [found[a:b] - [f, f, 0] for a, b, f in zip(cuts[:-1], cuts[1:], first, strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, end, period in runs.tolist():
        keep[start + period : end] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run (start, length, period) of most periods; of equals the first, then that of the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, n_words, runs, best, collapsed).

    runs: all runs of at least `times` periods and `least` words, by start and period; best: the one of most periods; collapsed: the
    words left when each run keeps its first period, joined by one space.  prepare: makes other words of (doc_id, words) first.
    A task holds a batch of texts; nothing is shuffled.
    """
    names = ["doc_id", "n_words", "runs", "best", "collapsed"]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = ("start", "length", "period")

    def rows(ids: list[int | None], texts: list[list[bytes]]):
        made = runs_of(texts, times, least)
        runs = [[(s, e - s, q) for s, e, q in r.tolist()] for r in made]
        best = [best_of(r) for r in runs]
        kept = [b" ".join(collapsed(t, r)) for t, r in zip(texts, made, strict=True)]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[dict(zip(fields, r, strict=True)) for r in rs] for rs in runs], pa.list_(run_type)),
            pa.array([None if b is None else dict(zip(fields, b, strict=True)) for b in best], run_type),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        for batch in batches:
            ids, texts, n = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = split_words(text.as_py())
                words = words if prepare is None else prepare(doc_id, words)
                if texts and n + len(words) > APPEND:
                    yield rows(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                n += len(words)
            if texts:
                yield rows(ids, texts)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(tidy(run), SCHEMA)
