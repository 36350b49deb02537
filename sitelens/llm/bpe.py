"""BPE encoding and decoding of whole texts with a public tokenizer file.

Chunks between ASCII white space encode independently of each other (white space starts no token, composes with
nothing and is dropped), so a task encodes each distinct chunk of a batch once and keeps a bounded memo of them.

Long texts are encoded by tree concatenation.  A text is halved, at any code point, until its leaves are small; leaves are
encoded in parallel tasks and joined in pairs.  At each join a window of chunks on either side is encoded anew, doubling
until its first chunk is again what the left side has and its last what the right side has: outside of it nothing can
differ.  A very long chunk without white space is joined in the same way by tokens: a token sequence in which
every adjacent pair is what the pair's own text encodes to is the encoding of the whole, so agreement makes it exact.

Edge cases: null and empty texts have no tokens and decode to ''; ids may be null or repeat, each row gives a row; of equal
long texts one is encoded; columns of other names are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy, written

#: Texts of at least so many bytes are halved until no leaf has more than LEAF bytes.
LONG_TEXT = 32768
LEAF = 8192
#: Tokens, or chunks, on either side of a join that are encoded anew at first.
WINDOW = 8
WINDOW_CHUNKS = 1
#: Chunks that a joined part keeps apart at either end for later windows.
EDGE = 4
#: Pieces that a task encodes and hands on at once.
PIECES = 128
#: Bound on the chunks that a worker remembers while a task runs, some 50 bytes each; without decoded texts twice as many, of some 35.
MEMO = 200_000
#: Bound on those that it remembers for the seams of joins, some 300 bytes each.
SEAMS = 20_000
#: Chunks that are encoded at once, which bounds the lists of their ids.
CODED = 16_384

#: Characters of one piece of a row of words.
ROW = 1024

#: Marks; a run of them at the end of a word is a word of its own there.
MARKS = string.punctuation
#: Letters of western languages: composed, and with one letter as lower case.
WESTERN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Byte-level letters: printable bytes stand for themselves, the others for code points from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
LETTERS = [BYTE_LETTERS.get(b, chr(b)) for b in range(256)]
#: From this code point on, a byte's letter at the end of a word.
LAST = 0xE000

_loaded: dict[str, ChunkEncoder] = {}


def packed_ids(lists: list[list[int]]) -> pa.Array:
    """Lists of ids as a binary array of little-endian unsigned 32-bit numbers."""
    ends = np.cumsum(np.fromiter((len(one) for one in lists), dtype=np.int32, count=len(lists)), dtype=np.int32)
    flat = np.fromiter(itertools.chain.from_iterable(lists), dtype="<u4", count=int(ends[-1]) if len(lists) else 0)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.concatenate([np.zeros(1, np.int32), 4 * ends])), pa.py_buffer(flat)])


def spans(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary array."""
    if not len(values):  # it may have no buffers
        return np.zeros(1, dtype=np.int32), np.zeros(0, dtype=np.uint8)
    _, offsets, data = values.buffers()
    return np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1], np.frombuffer(data or b"", dtype=np.uint8)


class WordRows:
    """Encodes rows of words at once.  The last letter of a word has a sign of its own instead of the end-of-word suffix.

    No merge starts with such a letter, so none reaches over the end of a word, and words may stand in one text without a gap.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        model = json.load(open(path))["model"]  # the tokenizer's own file, present on every executor
        suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Whether the file is of the kind that rows work for.
        self.fits = (
            bool(suffix)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and all(c in vocab and c + suffix in vocab for c in LETTERS)
            and not any(a.endswith(suffix) for a, _ in merges)
        )
        if not self.fits:
            return
        cut, sign = len(suffix) + 1, {c: chr(LAST + b) for b, c in enumerate(LETTERS)}

        def signed(token: str) -> str:
            return token[:-cut] + sign[token[-cut]] if token.endswith(suffix) else token

        self.tokenizer = Tokenizer(BPE({signed(t): i for t, i in vocab.items()}, [(a, signed(b)) for a, b in merges]))
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.letters = np.array([ord(c) for c in LETTERS], dtype="<u2")

    def encode(self, words: pa.Array) -> pa.Array:
        """The ids of words (none of them empty) of letters that pass the normaliser and pre-tokenizer as they are, as packed_ids has them."""
        if not len(words):
            return pa.array([], pa.binary())
        offsets, data = spans(words)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        row, last = self.letters[data], offsets[1:] - 1
        row[last] = LAST + data[last].astype("<u2")
        text = row.tobytes().decode("utf-16-le")
        cuts = np.unique(offsets[np.searchsorted(offsets, np.arange(0, len(text) + ROW, ROW)).clip(max=len(words))]).tolist()
        made = self.tokenizer.encode_batch_fast([text[a:b] for a, b in itertools.pairwise(cuts)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in made])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise RuntimeError("a row of words has other ends than its words")
        return pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(ids)])


class ChunkEncoder:
    """A tokenizer with bounded memos of chunks, words without the marks at their end: an Arrow table for batches, a small dictionary for the seams of joins.

    The dictionary has (ids as little-endian unsigned 32-bit, decoded bytes) by chunk.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.decode = True
        self.forget()
        self.rows = WordRows(path)
        runs = [*MARKS, ".,", MARKS]
        trial = ["thing", "Thing,", "q", "\u00c9a!$", *("thing" + m for m in runs)]
        words = [["thing"], ["thing", ","], ["q"], ["\u00c3\u00a9a", "!$"], *(["thing", m] for m in runs)]
        direct = [[t.id for w in pair for t in self.tokenizer.model.tokenize(w)] for pair in words]
        #: Whether the file lower-cases and keeps letters apart from marks, so both steps may be skipped for plain words.
        self.plain_words = self.rows.fits and [e.ids for e in self.tokenizer.encode_batch(trial, add_special_tokens=False)] == direct

    def forget(self) -> None:
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}
        self.known = (pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.binary()))

    def learn(self, chunks: list[bytes]) -> None:
        """Puts distinct chunks into the dictionary."""
        new = [c for c in chunks if c not in self.memo]
        if not new:
            return
        if len(self.memo) + len(new) > SEAMS:
            self.memo = {c: self.memo[c] for c in chunks if c in self.memo}
        ids, texts = self.of_chunks(pa.array([c.decode() for c in new], pa.string()), self.coded)
        self.memo.update(zip(new, zip(ids.to_pylist(), texts.to_pylist(), strict=True), strict=True))

    def split_marks(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """(keys, is_word, marks): chunks of letters with or without marks at their end are a word in lower case and the marks, others a key as they are."""
        if not self.plain_words:
            return chunks, np.zeros(len(chunks), dtype=bool), pa.array([b""], pa.binary()).take(pa.array(np.zeros(len(chunks), dtype=np.int64)))
        letters = pc.ascii_rtrim(chunks, characters=MARKS)
        is_word = pc.ascii_is_alpha(letters).to_numpy(zero_copy_only=False).copy()
        rest = pc.indices_nonzero(pc.invert(pc.string_is_ascii(letters)))
        is_word[rest.to_numpy()] = pc.match_substring_regex(letters.take(rest), WESTERN).to_numpy(zero_copy_only=False)
        offsets, data = spans(chunks)
        size = np.where(is_word, np.diff(offsets) - pc.binary_length(letters).to_numpy(), 0)
        before = np.concatenate([[0], np.cumsum(size)])
        flat = data[np.repeat(offsets[1:] - before[1:], size) + np.arange(before[-1])]
        marks = pa.BinaryArray.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(before.astype(np.int32)), pa.py_buffer(flat)])
        return pc.if_else(pa.array(is_word), pc.utf8_lower(letters), chunks), is_word, marks

    def of_chunks(self, chunks: pa.Array, made) -> tuple[pa.Array, pa.Array]:
        """Binary arrays: the ids and the decoded text, empty if not asked for, of distinct chunks; made gives those of keys."""
        keys, is_word, marks = self.split_marks(chunks)
        keys, marks = keys.dictionary_encode(), marks.dictionary_encode()
        of_word = np.zeros(len(keys.dictionary), dtype=bool)
        of_word[keys.indices.to_numpy()] = is_word
        ids, texts = (x.take(keys.indices) for x in made(keys.dictionary, of_word))
        if len(marks.dictionary) == 1 and not marks.dictionary[0].as_py():
            return ids, texts
        mark_ids, mark_texts = (x.take(marks.indices) for x in self.coded(marks.dictionary.cast(pa.string()), np.zeros(len(marks.dictionary), dtype=bool)))
        ids = pc.binary_join_element_wise(ids, mark_ids, b"")
        if self.decode:
            texts = pc.if_else(pc.equal(pc.binary_length(mark_ids), 0), texts, pc.binary_join_element_wise(texts, mark_texts, b" "))
        return ids, texts

    def coded(self, keys: pa.Array, is_word: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Binary arrays: the ids and the decoded text, empty if not asked for, of each of distinct keys."""
        ids, texts = [pa.array([], pa.binary())], [pa.array([], pa.binary())]
        for at in range(0, len(keys), CODED):
            part, word = keys.slice(at, CODED), is_word[at : at + CODED]
            own = self.rows.encode(part.filter(pa.array(word))) if word.any() else pa.array([], pa.binary())
            others = self.tokenizer.encode_batch_fast(part.filter(pa.array(~word)).to_pylist(), add_special_tokens=False)
            both = pa.concat_arrays([own, packed_ids([e.ids for e in others])])
            found = both.take(pa.array(np.where(word, np.cumsum(word) - 1, len(own) + np.cumsum(~word) - 1)))
            ids.append(found)
            if not self.decode:
                texts.append(pa.array([b""], pa.binary()).take(pa.array(np.zeros(len(part), dtype=np.int64))))
                continue
            lists = [np.frombuffer(i, dtype="<u4").tolist() for i in found.to_pylist()]
            texts.append(pa.array([t.encode() for t in self.tokenizer.decode_batch(lists, skip_special_tokens=False)], pa.binary()))
        return pa.concat_arrays(ids), pa.concat_arrays(texts)

    def look_up(self, distinct: pa.Array, is_word: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The ids and decoded texts of distinct keys, from the table or else made and put there."""
        keys, *held = self.known
        at = pc.index_in(distinct, value_set=keys)
        missing = pc.is_null(at)
        where = missing.to_numpy(zero_copy_only=False)
        new = distinct.filter(missing)
        made = self.coded(new, is_word[where])
        full = [pa.concat_arrays(both) for both in zip(held, made, strict=True)]
        place = pa.array(np.where(where, len(keys) + np.cumsum(where) - 1, at.fill_null(0).to_numpy()))
        ids, texts = (f.take(place) for f in full)
        most = MEMO if self.decode else 2 * MEMO
        if len(keys) + len(new) <= most:
            self.known = (pa.concat_arrays([keys, new]), *full)
        else:  # copies, as a slice would keep what the batch has besides
            self.known = tuple(pa.concat_arrays([x.slice(0, most), x.slice(0, 0)]) for x in (distinct, ids, texts))
        return ids, texts

    def chunks(self, texts: pa.Array, lower: bool = True) -> pa.ListArray:
        """The chunks of each text.  Lower case makes more of them equal; not where a special token may be written."""
        if lower and self.plain_words:
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        full = pc.not_equal(pc.binary_length(flat), 0)  # white space at either end leaves an empty one
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        offsets = np.asarray(split.offsets) - np.asarray(split.offsets)[0]
        return pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), flat.filter(full))

    def encode_lists(self, chunks: pa.ListArray) -> tuple[pa.Array, pa.Array]:
        """Binary arrays: the ids and the decoded text of each list of chunks."""
        coded = chunks.values.dictionary_encode()
        of_ids, of_texts = self.of_chunks(coded.dictionary, self.look_up)
        index = coded.indices
        joined = pc.binary_join(pa.ListArray.from_arrays(chunks.offsets, of_ids.take(index)), b"")
        if not self.decode:
            return joined, pa.nulls(len(joined), pa.binary())
        if pc.any(pc.equal(pc.binary_length(of_ids), 0)).as_py():  # a chunk without tokens leaves no space
            full = pc.not_equal(pc.binary_length(of_ids.take(index)), 0)
            before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
            return joined, pc.binary_join(pa.ListArray.from_arrays(pa.array(before[np.asarray(chunks.offsets)], pa.int32()), of_texts.take(index.filter(full))), b" ")
        return joined, pc.binary_join(pa.ListArray.from_arrays(chunks.offsets, of_texts.take(index)), b" ")

    def encode_texts(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        return self.encode_lists(self.chunks(texts))


def encoder(path: str, decode: bool = True) -> ChunkEncoder:
    """One encoder for each worker process and file; what it remembers goes when decoded texts are (not) asked for anew."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    held = _loaded[path]
    if held.decode != decode:
        held.forget()
        held.decode = decode
    return held


def forget() -> None:
    """Drops what the encoders of this process remember."""
    for held in _loaded.values():
        held.forget()


def forgetful(run):
    """A map function that drops the memos of its worker when the task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        gc.disable()  # very many small lists are made, and no cycles
        try:
            yield from run(batches)
        finally:
            gc.enable()
            forget()  # by name: a function sent to a worker takes a copy of the module's dictionaries with it

    return tidy(wrapped)


class TextTree:
    """Joins the encodings of adjacent parts of a text.

    A part is a list of items (chunk, ids, decoded) in order.  The first and last EDGE items are single chunks; those between
    are packed into one item without a chunk, so that a part of any length has few items.
    """

    def __init__(self, held: ChunkEncoder):
        self.held = held

    def items(self, chunks: list[bytes]) -> list[tuple]:
        self.held.learn(list(dict.fromkeys(chunks)))
        return [(c, *self.held.memo[c]) for c in chunks]

    @staticmethod
    def pack(items: list[tuple]) -> list[tuple]:
        if len(items) <= 2 * EDGE + 1:
            return items
        middle = items[EDGE:-EDGE]
        return [*items[:EDGE], (None, b"".join(i for _, i, _ in middle), b" ".join(t for _, i, t in middle if i)), *items[-EDGE:]]

    def leaf(self, text: bytes) -> list[tuple]:
        return self.leaves([text])[0]

    def leaves(self, texts: list[bytes]) -> list[list[tuple]]:
        """Packed items of each text; the chunks between the edges are encoded together."""
        lists = self.held.chunks(pa.array([t.decode() for t in texts], pa.string()), lower=False)
        offsets, flat = np.asarray(lists.offsets).astype(np.int64), lists.values
        size = np.diff(offsets)
        packed = size > 2 * EDGE + 1
        low, high = np.where(packed, offsets[:-1] + EDGE, offsets[1:]), np.where(packed, offsets[1:] - EDGE, offsets[1:])
        place = np.arange(len(flat))
        of = np.repeat(np.arange(len(size)), size)
        inner = (place >= low[of]) & (place < high[of])
        counts = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)
        ids, decoded = self.held.encode_lists(pa.ListArray.from_arrays(pa.array(counts), flat.filter(pa.array(inner))))
        edges = [c.encode() for c in flat.filter(pa.array(~inner)).to_pylist()]
        items, out, at = self.items(edges), [], 0
        for n, p, i, d in zip((size - (high - low)).tolist(), packed.tolist(), ids.to_pylist(), decoded.to_pylist(), strict=True):
            own, at = items[at : at + n], at + n
            out.append([*own[:EDGE], (None, i, d), *own[EDGE:]] if p else own)
        return out

    def join(self, left: list[tuple], right: list[tuple], cut_chunk: bool) -> list[tuple]:
        """cut_chunk: the cut went through a chunk, so the last of the left and the first of the right are one."""
        if not left or not right:
            return left or right
        window = WINDOW_CHUNKS
        while True:
            a, b = min(window, len(left)), min(window, len(right))
            before, after = [x[0] for x in left[len(left) - a :]], [x[0] for x in right[:b]]
            if None in before or None in after:
                raise RuntimeError("windows of a join met no agreement")
            seam = [before[-1] + after[0]] if cut_chunk else [before[-1], after[0]]
            anew = self.items([*before[:-1], *seam, *after[1:]])
            if (a == len(left) or anew[0] == left[-a]) and (b == len(right) or anew[-1] == right[b - 1]):
                return self.pack([*left[: len(left) - a], *anew, *right[b:]])
            window *= 2

    def tree(self, leaves: list[list[tuple]], cuts: list[bool]) -> list[tuple]:
        """Leaves in order; cuts[i] tells whether the cut after leaf i went through a chunk."""
        while len(leaves) > 1:
            n = len(leaves)
            leaves, cuts = [self.join(leaves[i], leaves[i + 1], cuts[i]) if i + 1 < n else leaves[i] for i in range(0, n, 2)], [cuts[i + 1] for i in range(0, n - 2, 2)]
        return leaves[0] if leaves else []


class TreeConcatenation:
    """Joins the encodings of adjacent parts of one word.  Parts and tokens are strings over the byte alphabet."""

    def __init__(self, path: str):
        from tokenizers.models import BPE

        model = json.load(open(path))["model"]  # the tokenizer's own file, present on every executor
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.last = BPE(model["vocab"], merges, end_of_word_suffix=self.suffix or None)
        self.inner = BPE(model["vocab"], merges)
        self.name = {i: s for s, i in model["vocab"].items()}

    def leaf(self, text: str, ends_word: bool) -> list[int]:
        return [t.id for t in (self.last if ends_word else self.inner).tokenize(text)]

    def text_of(self, ids: list[int], ends_word: bool) -> str:
        text = "".join(self.name[i] for i in ids)
        return text[: len(text) - len(self.suffix)] if ends_word and self.suffix else text

    def join(self, left: list[int], right: list[int], ends_word: bool, window: int = WINDOW) -> list[int]:
        while True:
            a, b = min(window, len(left)), min(window, len(right))
            ends = ends_word and b == len(right)
            anew = self.leaf(self.text_of(left[len(left) - a :] + right[:b], ends), ends)
            if (a == len(left) or anew[0] == left[-a]) and (b == len(right) or anew[-1] == right[b - 1]):
                return left[: len(left) - a] + anew + right[b:]
            window *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Leaves of one whole word, in order."""
        while len(leaves) > 1:
            n = len(leaves)
            leaves = [
                self.join(leaves[i], leaves[i + 1], i + 2 >= n) if i + 1 < n else leaves[i] for i in range(0, n, 2)
            ]
        return leaves[0] if leaves else []


_trees: dict[str, TreeConcatenation] = {}


def tree_of(path: str) -> TreeConcatenation:
    """Held by a worker from its first very long chunk on, since the models of all merges take some 20 to 30 MB."""
    if path not in _trees:
        _trees[path] = TreeConcatenation(path)
    return _trees[path]


#: Kinds of pieces: half of a text before a cut between chunks or through one, special token, whole words, leaves of a word.
HALF, HALF_CUT, SPECIAL, WORDS, LEAF_OF_WORD, LAST_LEAF = range(6)


def halves(text: bytes, leaf: int) -> Iterator[bytes]:
    """Leaves of a text, in order: it is cut in half at a code point until no leaf is too long."""
    if len(text) <= leaf:
        yield text
        return
    middle = len(text) // 2
    while middle > 0 and text[middle] & 0xC0 == 0x80:
        middle -= 1
    yield from halves(text[:middle], leaf)
    yield from halves(text[middle:], leaf)


def pieces_of(text: bytes, path: str, leaf: int) -> Iterator[tuple[int, str]]:
    """Pieces of a text in order: leaves of text; and for chunks longer than a leaf special tokens, words and leaves of one long word."""
    if encoder(path).plain_words and b"<|" not in text:  # for the whole text: a cut may go through a special token
        text = text.lower()
    at = 0
    for run in re.finditer(rb"[^\x20\x09-\x0D]{%d,}" % (leaf + 1), text):
        yield from _halved(text[at : run.start()], leaf)
        yield from _long_chunk(run[0].decode(), path, leaf)
        at = run.end()
    yield from _halved(text[at:], leaf)


def _halved(text: bytes, leaf: int) -> Iterator[tuple[int, str]]:
    leaves = list(halves(text.strip(b" \t\n\r\x0b\f"), leaf))
    for i, part in enumerate(leaves):
        cut = i + 1 < len(leaves) and not part[-1:].isspace() and not leaves[i + 1][:1].isspace()
        yield HALF_CUT if cut else HALF, part.decode()


def _long_chunk(chunk: str, path: str, leaf: int) -> Iterator[tuple[int, str]]:
    tokenizer = encoder(path).tokenizer
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    for part in cut.split(chunk) if cut else [chunk]:
        if part in special:
            yield SPECIAL, part
            continue
        words: list[str] = []
        size = 0
        for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(part)):
            if words and size + len(word) > leaf:
                yield WORDS, " ".join(words)
                words, size = [], 0
            if len(word) <= leaf:
                words.append(word)
                size += len(word)
                continue
            for i in range(0, len(word), leaf):
                yield (LAST_LEAF if i + leaf >= len(word) else LEAF_OF_WORD), word[i : i + leaf]
        if words:
            yield WORDS, " ".join(words)


def narrowed(ids: pa.Array) -> pa.Array:
    """Ids of 32 bits as ids of 16 bits; the greatest number stands for padding, so no id may have it."""
    ids = ids.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
    flat = np.frombuffer(ids.buffers()[2] or b"", dtype="<u4", count=int(offsets[-1]) // 4)[int(offsets[0]) // 4 :] if len(ids) else np.zeros(0, dtype="<u4")
    if len(flat) and flat.max() >= 65_535:
        raise ValueError("token ids don't fit 16 bits")
    small = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer((offsets - offsets[0]) // 2), pa.py_buffer(flat.astype("<u2"))])
    return small.cast(pa.binary())


def encode_short(docs: DataFrame, path: str, decode: bool = True, narrow: bool = False) -> DataFrame:
    """All columns of docs, then n_tokens, ids and decoded (null if not asked for); a map without a shuffle."""
    names, at = [*docs.columns, "n_tokens", "ids", "decoded"], docs.columns.index("text")

    def run(batches):
        held = encoder(path, decode)
        for batch in batches:
            ids, decoded = held.encode_texts(batch.column(at).cast(pa.string()).fill_null(""))
            n = pc.divide(pc.binary_length(ids), 4).cast(pa.int64())
            ids = narrowed(ids) if narrow else ids
            yield pa.RecordBatch.from_arrays([*batch.columns, n, ids, decoded.cast(pa.string())], names=names)
            ids = decoded = None
            pa.default_memory_pool().release_unused()  # the allocator would keep some 100 MB for the next batch

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return docs.mapInArrow(forgetful(run), T.StructType([*docs.schema.fields, *added]))


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, PIECES at most at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECES):
            yield batch.slice(at, PIECES)


def encode_long(texts: DataFrame, path: str, leaf: int, decode: bool = True, narrow: bool = False) -> DataFrame:
    """Distinct long texts (key, text) to (key, n_tokens, ids, decoded: null if not asked for), by tree concatenation over tasks."""

    def split(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                rows = list(pieces_of(text, path, leaf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())],
                    names=["key", "piece", "kind", "text"],
                )

    item = pa.struct([("chunk", pa.binary()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def encode(batches):
        held, halving = encoder(path), TextTree(encoder(path))
        for batch in in_parts(batches):
            out = []
            kinds, texts = batch.column("kind").to_pylist(), batch.column("text").to_pylist()
            made = iter(halving.leaves([t.encode() for k, t in zip(kinds, texts, strict=True) if k in (HALF, HALF_CUT)]))
            for kind, text in zip(kinds, texts, strict=True):
                if kind in (HALF, HALF_CUT):
                    out.append([dict(zip(("chunk", "ids", "decoded"), x, strict=True)) for x in next(made)])
                    continue
                if kind == SPECIAL:
                    got = [held.tokenizer.token_to_id(text)]
                elif kind == WORDS:
                    got = [i for word in text.split(" ") for i in tree_of(path).leaf(word, True)]
                else:
                    got = tree_of(path).leaf(text, kind == LAST_LEAF)
                done = kind in (SPECIAL, WORDS)
                decoded = held.tokenizer.decode(got, skip_special_tokens=False).encode() if done else b""
                out.append([{"chunk": None, "ids": np.asarray(got, dtype="<u4").tobytes(), "decoded": decoded}])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), batch.column("kind"), pa.array(out, pa.list_(item))], names=["key", "piece", "kind", "items"])
            pa.default_memory_pool().release_unused()

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        held, halving = encoder(path), TextTree(encoder(path))
        ids, decoded, leaves, cuts, of_word = [], [], [], [], []

        def put(items):
            ids.extend(i for _, i, _ in items)
            decoded.extend(t for _, i, t in items if i)

        rows = rows.sort_values("piece")
        for kind, items in zip(rows["kind"], rows["items"], strict=True):
            items = [(x["chunk"], x["ids"], x["decoded"]) for x in items]
            if kind in (HALF, HALF_CUT):
                leaves.append(items)
                cuts.append(kind == HALF_CUT)
                continue
            put(halving.tree(leaves, cuts))  # a long chunk stands between white space: what comes before it is complete
            leaves, cuts = [], []
            if kind in (SPECIAL, WORDS):
                put(items)
                continue
            of_word.append(np.frombuffer(items[0][1], dtype="<u4").tolist())
            if kind == LAST_LEAF:
                got = tree_of(path).tree(of_word)
                put([(None, np.asarray(got, dtype="<u4").tobytes(), held.tokenizer.decode(got, skip_special_tokens=False).encode())])
                of_word = []
        put(halving.tree(leaves, cuts))
        whole = b"".join(ids)
        n_tokens, whole = len(whole) // 4, narrowed(pa.array([whole], pa.binary()))[0].as_py() if narrow else whole
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "n_tokens": [n_tokens], "ids": [whole], "decoded": [b" ".join(decoded).decode() if decode else None]})

    pieces = texts.mapInArrow(forgetful(split), "key string, piece int, kind int, text string").repartition("key", "piece")
    encoded = pieces.mapInArrow(forgetful(encode), "key string, piece int, kind int, items array<struct<chunk:binary,ids:binary,decoded:binary>>")
    return encoded.groupBy("key").applyInPandas(gather, "key string, n_tokens long, ids binary, decoded string")


def encode_documents(docs: DataFrame, path: str, long_text: int = LONG_TEXT, leaf: int = LEAF, decode: bool = True, narrow: bool = False) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, n_tokens, ids: little-endian unsigned 32-bit, decoded).

    Without decode the decoded texts are null; with narrow the ids have 16 bits.

    Short texts are encoded where they are read.  Of the long ones each distinct text is encoded once, its leaves spread
    over tasks, and joined back to its documents.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") >= long_text, F.lit(False))
    short = encode_short(docs.filter(~is_long), path, decode, narrow).drop("text")
    long = docs.filter(is_long).withColumn("key", F.sha2("text", 256))
    # written, so that the join can split the rows of a text with very many copies
    made = written(encode_long(long.groupBy("key").agg(F.first("text").alias("text")), path, leaf, decode, narrow), True)
    return short.unionByName(long.select("doc_id", "key").join(made, "key").select("doc_id", "n_tokens", "ids", "decoded"))
