"""Vectorised text helpers used inside Arrow map functions.

A *block* is a run of whole documents laid end to end as one ``uint8`` array with an
offsets array.  A word stands for 128 bits: of its BLAKE2b digest, taken once for each distinct word of a block, or, within
one run, of a fast hash under a secret key, so that no words can be made to collide.  The hash of a shingle has both
halves of its words' bits, in two lanes, and 64 bits.  The hash of a byte range is a polynomial prefix
sum (modulo 2**64, odd base) of mixed eight-byte strings, two look-ups a range: fast, but texts can be made on which it
agrees, so it may choose what to compare and must not decide.
Nothing here needs Spark; memory is bounded by ``BLOCK_BYTES`` or one document.
"""

from __future__ import annotations

import functools
import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bound on the words whose digests a task remembers, some 200 bytes each.
MOST_DIGESTS = 300_000
_digests: dict[bytes, bytes] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i up to n; grown as needed and kept."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        pair = []
        for factor in (base, inverse):
            column = np.full(size, factor, dtype=np.uint64)
            column[0] = 1
            pair.append(np.cumprod(column, dtype=np.uint64))
        have = _tables[base] = (pair[0], pair[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word (splitmix constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Factors of the two lanes of a row of words.
_LANES = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def both_lanes(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """One hash of the two lanes of n words; words that agree in one lane only stay apart."""
    return mix(mix(a + np.uint64(n)) + b)


def forget() -> None:
    """Drops the tables of powers and the digests of words."""
    _tables.clear()
    _digests.clear()


def word_digests(words: list[bytes]) -> list[bytes]:
    """BLAKE2b digests of distinct words; a task remembers them from block to block."""
    if len(_digests) > MOST_DIGESTS:
        _digests.clear()
    out = []
    for w in words:
        d = _digests.get(w)
        if d is None:
            d = _digests[w] = hashlib.blake2b(w, digest_size=16).digest()
        out.append(d)
    return out


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number; beyond the end they are 0."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _first_bytes(lane: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n (1 to 7) bytes of each lane."""
    return lane & ((np.uint64(1) << (n.astype(np.uint64) << np.uint64(3))) - np.uint64(1))


#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: Multipliers of the two halves of a keyed word hash.
_HALVES = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)


def secret_key() -> tuple[int, int]:
    """A key that nobody knows beforehand, for hashes within one run."""
    return random.SystemRandom().getrandbits(64), random.SystemRandom().getrandbits(64)


def keyed_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """128 bits, in two columns, of non-overlapping byte ranges, under a secret key: each eight bytes are mixed into what came before."""
    length, lanes = end - start, lanes_of(data)
    out = np.empty((len(start), 2), dtype=np.uint64)
    for half in range(2):
        out[:, half] = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key[half]))
    for i in np.flatnonzero(length > LONG_WORD):
        whole = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16, key=b"".join(k.to_bytes(8, "little") for k in key))
        out[i] = np.frombuffer(whole.digest(), dtype="<u8")
    active, done = np.flatnonzero(length <= LONG_WORD), 0
    while len(active):
        left = length[active] - done
        lane = lanes[start[active] + done]
        part = left < 8
        lane[part] = _first_bytes(lane[part], left[part])
        for half, factor in enumerate(_HALVES):
            out[active, half] = mix((out[active, half] ^ lane) * np.uint64(factor) + np.uint64(key[half]))
        active, done = active[left > 8], done + 8
    return out


class RangeHash:
    """Hashes of byte ranges of one array."""

    def __init__(self, data: np.ndarray):
        base = _BASE
        power, self._inverse = _powers(base, len(data))
        self._lanes = lanes_of(data)
        self._prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        value = mix(self._lanes[: len(data)] ^ np.uint64(base))
        value *= power[: len(data)]
        np.cumsum(value, out=self._prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        last = np.maximum(end - 7, start)  # the last eight bytes of a range start before here
        raw = (self._prefix[last] - self._prefix[start]) * self._inverse[start]
        short = np.flatnonzero(length < 8)
        if len(short):
            lane = self._lanes[start[short]]
            n = length[short]
            raw[short] = np.where(n > 0, _first_bytes(lane, np.maximum(n, 1)), np.uint64(0))
        return mix(raw ^ (length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def span_digests(data: np.ndarray, first: np.ndarray, end: np.ndarray, size: int = 1) -> np.ndarray:
    """64 bits of BLAKE2b of each span of a contiguous array, whose items have so many bytes."""
    view = memoryview(data).cast("B")
    made = b"".join([hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip((first * size).tolist(), (end * size).tolist(), strict=True)])
    return np.frombuffer(made, dtype="<u8")


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Words (runs without ASCII white space) of a block: byte ranges, document index, digests.

    key: a secret of one run, under which words are hashed fast; without it their digests are the same in every run.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, key: tuple[int, int] | None = None):
        n_docs, self.key = len(offsets) - 1, key
        self.data = data = _LOWER[data] if lower else data
        inside = _WORD[data]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[filled] = False
        after[filled[1:] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self._ranges: RangeHash | None = None

    @property
    def ranges(self) -> RangeHash:
        if self._ranges is None:
            self._ranges = RangeHash(self.data)
        return self._ranges

    @functools.cached_property
    def digests(self) -> np.ndarray:
        """128 bits of each word in two columns: keyed, or of its BLAKE2b digest, which each distinct word of the block is given once."""
        if self.key is not None:
            return keyed_hashes(self.data, self.start, self.end, self.key)
        length = np.concatenate([[0], np.cumsum(self.end - self.start)])
        letters = np.ascontiguousarray(self.data[_WORD[self.data]])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(length), pa.py_buffer(letters)]).dictionary_encode()
        return np.frombuffer(b"".join(word_digests(words.dictionary.to_pylist())), dtype="<u8").reshape(-1, 2)[words.indices.to_numpy()]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets by document) of all k-word shingles; a shorter text is one shingle."""
        h, n_docs = self.digests, len(self.count)
        n_out = np.where(self.count >= k, self.count - k + 1, (self.count > 0).astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum(n_out)])
        out = np.empty(int(offsets[-1]), dtype=np.uint64)
        if len(h) >= k:
            rolled = np.zeros((2, len(h) - k + 1), dtype=np.uint64)
            for lane, factor in enumerate(_LANES):
                own = np.ascontiguousarray(h[:, lane])
                for j in range(k):
                    rolled[lane] = rolled[lane] * factor + own[j : len(h) - k + 1 + j]
            rolled = both_lanes(rolled[0], rolled[1], k)
            whole = self.doc[: len(rolled)] == self.doc[k - 1 :]
            doc = self.doc[: len(rolled)][whole]
            at = np.flatnonzero(whole) - self.first[doc] + offsets[doc]
            out[at] = rolled[whole]
        for d in np.flatnonzero((self.count > 0) & (self.count < k)):
            value = np.zeros((2, 1), dtype=np.uint64)
            for w in h[self.first[d] : self.first[d + 1]]:
                value = value * _LANES[:, None] + w[:, None]
            out[offsets[d]] = both_lanes(value[0], value[1], int(self.count[d]))[0]
        assert len(offsets) == n_docs + 1
        return out, offsets


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs that Spark stores."""
    return h.view(np.int64)
