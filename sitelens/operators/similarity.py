"""Text similarity: TF-IDF cosine joins, name similarity, matching."""

from __future__ import annotations

import contextlib
import ctypes
import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..sources.materialise import discard, sized
from . import scoring

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _joined(words: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def ngrams(words: Column, low: int, high: int) -> Column:
    parts = [words] if low == 1 else []
    for n in range(max(2, low), high + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _joined(words, n)))
    return F.concat(*parts)


def raw_tfidf(
    docs: DataFrame, key: str, text: str, low: int = 1, high: int = 1, stop: list[str] | None = None, max_features: int | None = None, max_df: float = 1.0, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(key, term, w, df): weights tf * (ln((1 + n) / (1 + df)) + 1).  With max_features the commonest terms, ties by term.

    keep writes the term counts, which are read twice: for df and for the weights.  Where only the commonest terms are wanted
    these are found first, by their totals alone, so that counts by document are of no other terms.
    """
    words = tokens(F.col(text))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    each = docs.select(key, words.alias("words")).select(key, F.explode(ngrams(F.col("words"), low, high)).alias("term"))
    n = docs.select(key).distinct().count()  # reads no texts
    first = max_features is not None and max_df >= 1
    if first:
        commonest = each.groupBy("term").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(max_features).select("term")
        commonest = sized(commonest if keep is None else keep(commonest))
        each = each.join(commonest, "term")
    tf = each.groupBy(key, "term").agg(F.count("*").alias("tf"))
    tf = tf if keep is None else keep(tf)
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if max_df < 1:
        vocabulary = vocabulary.filter(F.col("df") <= max_df * n)
    if max_features is not None and not first:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
    vocabulary = vocabulary.select("term", "df")
    if max_features is not None:
        vocabulary = sized(vocabulary if keep is None else keep(vocabulary))
    return tf.join(vocabulary, "term").select(key, "term", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"), "df")


def tfidf(docs: DataFrame, key: str, text: str, *args, **options) -> DataFrame:
    """raw_tfidf with vectors of unit length."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw_tfidf(docs, key, text, *args, **options).select(key, "term", (F.col("w") / norm).alias("w"), "df")


def vector_profile(raw: DataFrame, key: str) -> DataFrame:
    """(key, n_terms, top_weight, total) of unit vectors, from raw weights: sums, so that no vector is put together."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    return raw.groupBy(key).agg(F.count("*").alias("n_terms"), F.round(F.max("w") / norm, 6).alias("top_weight"), F.round(F.sum("w") / norm, 5).alias("total"))


#: Postings of a prefix term that meet in one task; a term of more is dealt into parts that meet pair by pair.
POSTINGS = 2000


def prefixes(packed: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, h, w, rest) of the prefix of each packed vector (key, h, w: rarest terms first); rest: the norm of all commoner terms."""
    kind = dict(packed.dtypes)[key]

    def run(batches):
        for batch in batches:
            keys, places, out_h, out_w, out_rest = [], [], [], [], []
            for i, (h, w) in enumerate(zip(batch.column("h"), batch.column("w"), strict=True)):
                h, w = h.values.to_numpy(), w.values.to_numpy()
                from_here = np.sqrt(np.cumsum((w * w)[::-1])[::-1])  # the norm of this term and all commoner ones
                n = int((from_here >= threshold - 1e-9).sum())
                places.append(np.full(n, i))
                out_h.append(h[:n])
                out_w.append(w[:n])
                out_rest.append(np.append(from_here[1:], 0.0)[:n])
            if places:
                keys = batch.column(key).take(pa.array(np.concatenate(places)))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate(c)) for c in (out_h, out_w, out_rest))], names=[key, "h", "w", "rest"])

    return packed.select(key, "h", "w").mapInArrow(run, f"{key} {kind}, h long, w double, rest double")


def pairs_in_groups(rows: DataFrame, group: str, key: str, columns: list[str], most: int = POSTINGS) -> DataFrame:
    """Pairs (a, b), a < b, of rows of one group, with the columns of either as <column>_a and <column>_b.

    A group of more than `most` rows is dealt into parts, and each pair of parts is a join key of its own, so no task meets more
    than most x most pairs of a group.
    """
    parts = rows.groupBy(group).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts"))
    dealt = rows.join(parts, group).withColumn("__part", F.pmod(F.xxhash64(key), F.col("__parts").cast("long")).cast("int"))
    own = [key, *columns]
    x = dealt.select(group, F.col("__part").alias("__i"), F.explode(F.sequence(F.col("__part"), F.col("__parts") - 1)).alias("__j"), *[F.col(c).alias(f"{c}_a") for c in own])
    y = dealt.select(group, F.col("__part").alias("__j"), F.explode(F.sequence(F.lit(0), F.col("__part"))).alias("__i"), *[F.col(c).alias(f"{c}_b") for c in own])
    one, other = F.col(f"{key}_a"), F.col(f"{key}_b")
    met = x.join(y, [group, "__i", "__j"]).filter(F.when(F.col("__i") < F.col("__j"), one != other).otherwise(one < other))
    return met.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"), *[f"{c}_{side}" for c in columns for side in "ab"])


def cosine_candidates(packed: DataFrame, key: str, threshold: float, keep: Callable[[DataFrame], DataFrame], most: int = POSTINGS) -> DataFrame:
    """(a, b) with a < b that may have a cosine above the threshold.

    A vector's prefix ends where the norm of the rest falls below the threshold, so two vectors above it share a prefix term.
    Up to the last prefix term that both have, all common terms are in both prefixes; after it their product is at
    most that of the norms that are left, so the sum of both bounds the cosine.  cosine_pairs compares whole blocks instead, which
    shuffles no pairs.
    """
    met = pairs_in_groups(keep(prefixes(packed, key, threshold)), "h", key, ["w", "rest"], most)
    bound = met.groupBy("a", "b").agg((F.sum(F.col("w_a") * F.col("w_b")) + F.min(F.col("rest_a") * F.col("rest_b"))).alias("bound"))
    return bound.filter(F.col("bound") >= threshold - 1e-9).select("a", "b")


def packed_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """(key, h, w): arrays of hashed terms and weights, the rarest term first."""
    order = F.array_sort(F.collect_list(F.struct("df", F.xxhash64("term").alias("h"), "w")))
    return vectors.groupBy(key).agg(order.alias("v")).select(key, F.transform("v", lambda s: s["h"]).alias("h"), F.transform("v", lambda s: s["w"]).alias("w"))


#: Vectors and terms of a block, at most, and terms that are sent to the tasks.
BLOCK, BLOCK_TERMS, MOST_SHARED = 2048, 500_000, 4_000_000
#: Commonest terms with a place of their own in a sketch, and groups of all others, in fine sketches too.
HEADS, GROUPS, FINE = 256, 512, 7936
#: Vectors of a block that are bounded at a time, one pair of how many has to be left for fine sketches, and parts whose ones are held.
STRIP, MANY, HELD = 128, 64, 4
#: What single precision may take off a bound; blocks that a task holds of either side; bytes of a batch.
SLACK, A_TASK, ARROW_BYTES = 1e-4, 2, 4 << 20


def vector_blocks(rows: DataFrame, key: str, most: int, terms: int = BLOCK_TERMS) -> DataFrame:
    """Vectors (key, h, w: arrays) as rows of up to `most` of them and so many terms: block, keys, ends, vocabulary, ids, w.

    A vector without terms is near none and left out.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches):
        def block():
            held.sort(key=lambda v: len(v[1]))  # texts of about one length are alike in how many others they may be near
            vocabulary, ids = np.unique(np.concatenate([h for _, h, _ in held]), return_inverse=True)
            parts = [np.cumsum([len(h) for _, h, _ in held]), vocabulary, ids.astype(np.int32), np.concatenate([w for *_, w in held])]
            return pa.RecordBatch.from_pydict({"keys": pa.array([[k for k, *_ in held]])} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("ends", "vocabulary", "ids", "w"), parts, strict=True)})

        held: list[tuple] = []
        n = 0
        for batch in batches:
            for k, h, w in zip(batch.column(key).to_pylist(), batch.column("h"), batch.column("w"), strict=True):
                if held and (len(held) == most or n + len(h.values) > terms):
                    yield block()
                    held, n = [], 0
                if len(h.values):
                    held.append((k, h.values.to_numpy().copy(), w.values.to_numpy().copy()))  # a view would keep its batch
                    n += len(h.values)
        if held:
            yield block()

    schema = f"keys array<{kind}>, ends binary, vocabulary binary, ids binary, w binary"
    return rows.select(key, "h", "w").mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


class VectorBlock:
    """Vectors side by side, and a sketch of each: weights of the commonest terms (heads, ascending) and norms of groups of all others.

    In each group the product of two norms is at least that of the vectors, so the product of two sketches bounds the cosine.
    """

    def __init__(self, ends: np.ndarray, vocabulary: np.ndarray, ids: np.ndarray, w: np.ndarray, heads: np.ndarray):
        self.vocabulary, self.ids, self.w, self.n, self.heads = vocabulary, ids, w, len(ends), heads
        self.ends = np.append(0, ends)
        self.sketch = self.sketches(0, self.n, GROUPS)

    def sketches(self, lo: int, hi: int, groups: int) -> np.ndarray:
        own = np.minimum(np.searchsorted(self.heads, self.vocabulary), len(self.heads) - 1)
        group = np.where(self.heads[own] == self.vocabulary, own, len(self.heads) + self.vocabulary % groups)
        dims, ends = len(self.heads) + groups, self.ends[lo : hi + 1]
        part = slice(ends[0], ends[-1])
        squares = np.bincount(np.repeat(np.arange(hi - lo) * dims, np.diff(ends)) + group[self.ids[part]], weights=self.w[part] ** 2, minlength=(hi - lo) * dims)
        return np.sqrt(squares, out=squares).astype(np.float32).reshape(hi - lo, dims)

    def near(self, other: VectorBlock, threshold: float):
        """(places in self, places in other, cosines) of the pairs above the threshold, strip by strip; of one block each pair once.

        Where many pairs of a part of a strip are left, as of long texts, they are bounded by finer sketches first.
        """
        at = np.minimum(np.searchsorted(self.vocabulary, other.vocabulary), len(self.vocabulary) - 1)
        both = self.vocabulary[at] == other.vocabulary
        kept = np.flatnonzero(both[other.ids])
        theirs = np.searchsorted(kept, other.ends), at.astype(np.int32)[other.ids[kept]], other.w[kept]  # terms of both blocks only
        dense, fine = np.zeros(len(self.vocabulary)), {}
        for lo in range(0, self.n, STRIP):
            may = self.sketch[lo : lo + STRIP] @ other.sketch.T >= threshold - SLACK
            if other is self:
                may &= np.arange(lo, lo + len(may))[:, None] < np.arange(self.n)
            mine = None
            for first in range(0, other.n, STRIP):
                part = may[:, first : first + STRIP]
                if np.count_nonzero(part) * MANY > part.size:
                    if mine is None:
                        mine = self.sketches(lo, lo + len(may), FINE)
                    if first not in fine:
                        if len(fine) == HELD:
                            del fine[next(iter(fine))]
                        fine[first] = other.sketches(first, first + part.shape[1], FINE)
                    part &= mine @ fine[first].T >= threshold - SLACK
            a, b = np.nonzero(may)
            if len(a):
                got = self.cosines(a + lo, b, *theirs, dense)
                above = got > threshold
                yield a[above] + lo, b[above], got[above]

    def cosines(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray, ids: np.ndarray, w: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Cosines of pairs in ascending order of a: one vector of self against all of its pairs.  ends, ids, w: the others' vectors; dense: zeros."""
        out, starts, n = np.zeros(len(a)), ends[b], ends[b + 1] - ends[b]
        cuts = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = slice(self.ends[a[lo]], self.ends[a[lo] + 1])
            dense[self.ids[own]] = self.w[own]
            end = np.cumsum(n[lo:hi])
            take = np.repeat(starts[lo:hi] - end + n[lo:hi], n[lo:hi]) + np.arange(end[-1])
            product = dense[ids[take]] * w[take]
            some = np.flatnonzero(n[lo:hi])  # reduceat takes no empty ones
            if len(some):
                out[lo + some] = np.add.reduceat(product, (end - n[lo:hi])[some])
            dense[self.ids[own]] = 0.0
        return out


def block_cosines(blocks: DataFrame, threshold: float, heads: np.ndarray) -> DataFrame:
    """(a, b, cosine) with a < b of the vectors in blocks: each block meets each other one in some task, and only pairs that are
    above the threshold leave it.  Blocks are read where they meet, so no pair and no vector is shuffled.  heads: hashes of the commonest terms."""
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    kind = dict(blocks.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    names = ["block", "keys", "ends", "vocabulary", "ids", "w"]
    parts = max(1, -(-blocks.count() // A_TASK))  # else there are as many tasks as there are pairs of files, however small
    x, y = (blocks.coalesce(parts).select(*[F.col(c).alias(f"{c}_{side}") for c in names]) for side in "xy")
    heads = np.sort(heads)

    def run(batches):
        known: dict[int, VectorBlock] = {}
        kinds = {"ends": np.int64, "vocabulary": np.int64, "ids": np.int32, "w": np.float64}

        def of(batch, i, side):
            return VectorBlock(*(np.frombuffer(batch.column(f"{c}_{side}")[i].as_buffer(), dtype=kinds[c]) for c in names[2:]), heads)

        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (batch.column(f"block_{side}")[i].as_py() for side in "xy")
                if one not in known:
                    known = {one: of(batch, i, "x")}  # a block meets others in a row, so no other one is remembered
                held = known[one]
                other = held if one == two else of(batch, i, "y")
                for a, b, cosine in held.near(other, threshold):
                    keys = [batch.column(f"keys_{side}")[i].values.take(pa.array(at)) for side, at in (("x", a), ("y", b))]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(cosine)], names=["x", "y", "cosine"])
                del other
        known.clear()
        pa.default_memory_pool().release_unused()  # workers are kept for other tasks
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    # of two blocks either is x, by a hash of both, so that tasks have about as many pairs each
    one, two = F.col("block_x"), F.col("block_y")
    odd = F.pmod(F.xxhash64(F.least(one, two), F.greatest(one, two)), F.lit(2)) == 1
    met = x.join(y.hint("shuffle_replicate_nl"), (one == two) | ((one < two) == odd))
    return met.mapInArrow(run, f"x {kind}, y {kind}, cosine double").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def commonest(df: DataFrame) -> np.ndarray:
    """Hashes of the commonest terms of (h, df)."""
    return np.array([r.h for r in df.orderBy(F.desc("df"), "h").limit(HEADS).select("h").collect()] or [0], dtype=np.int64)


def cosine_pairs(vectors: DataFrame, key: str, threshold: float, keep: Callable[[DataFrame], DataFrame], most: int = BLOCK) -> DataFrame:
    """(a, b, cosine) with a < b and cosine above a threshold of some size, of vectors (key, term, w, df) in blocks of up to `most`.

    Groups of equal vectors should be collapsed first.
    """
    hashed = vectors.select(key, F.xxhash64("term").alias("h"), "w", "df")
    heads = commonest(hashed.groupBy("h").agg(F.max("df").alias("df")))
    rows = hashed.groupBy(key).agg(F.collect_list(F.struct("h", "w")).alias("v"))
    return block_cosines(keep(vector_blocks(rows.select(key, *[F.col(f"v.{c}").alias(c) for c in ("h", "w")]), key, most)), threshold, heads)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, n): hashed distinct terms of each text that has any, and how often each is there."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for batch in batches:
            counted = [np.unique(h.values.to_numpy(), return_counts=True) for h in batch.column("h")]
            lists = [pa.array([c[i] for c in counted], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *lists], names=[key, "h", "n"])

    hashed = docs.select(key, F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("h"))
    return hashed.filter(F.size("h") > 0).mapInArrow(run, f"{key} {kind}, h array<long>, n array<long>")


def commoner(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(h, df) of the commonest terms, at most so many, and of all others, if there are any."""
    if df.count() <= most:
        return df, None
    held, least = 0, None
    for r in df.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).collect():  # a row for each number of documents
        held += r.n
        if held > most:
            break
        least = r.df
    return (df.limit(0), df) if least is None else (df.filter(F.col("df") >= least), df.filter(F.col("df") < least))


class SentCounts:
    """Terms (h, df) for the tasks, to be looked up in ascending arrays."""

    def __init__(self, df: DataFrame):
        table = df.select("h", "df").toArrow()
        h, n = table.column("h").to_numpy(), table.column("df").to_numpy().astype(np.int32)
        order = np.argsort(h)
        self.sent = df.sparkSession.sparkContext.broadcast((h[order], n[order]))

    def of(self, h: np.ndarray) -> np.ndarray:
        """Documents of each term, 0 where it was not sent."""
        known, n = self.sent.value
        if not len(known):
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, n[at], 0).astype(np.int64)


def single_terms(counts: DataFrame, key: str, sent: SentCounts) -> DataFrame:
    """(key, h, n), a row each, of the terms of counts that were not sent."""
    kind = dict(counts.dtypes)[key]

    def run(batches):
        for batch in batches:
            places, hs, ns = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for i, (h, n) in enumerate(zip(batch.column("h"), batch.column("n"), strict=True)):
                h, n = h.values.to_numpy(), n.values.to_numpy()
                rest = sent.of(h) == 0
                places.append(np.full(int(rest.sum()), i))
                hs.append(h[rest])
                ns.append(n[rest])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.concatenate(places))), *(pa.array(np.concatenate(c)) for c in (hs, ns))], names=[key, "h", "n"])

    return counts.select(key, "h", "n").mapInArrow(run, f"{key} {kind}, h long, n long")


def unit_vectors(counts: DataFrame, df: DataFrame, key: str, n_docs: int, most_shared: int = MOST_SHARED) -> DataFrame:
    """(key, h, w): TF-IDF vectors of unit length of counts (key, h, n); df (h, df) has the terms of several documents.

    Terms of one document are in the norm only.  The most_shared commonest terms are sent to the tasks; of the others only what
    documents have of them is joined.
    """
    kind = dict(counts.dtypes)[key]
    head, tail = commoner(df, most_shared)
    sent = SentCounts(head)
    if tail is None:
        rows = counts.select(key, "h", "n", F.lit(None).cast("array<long>").alias("rare"), F.lit(None).cast("array<long>").alias("df"))
    else:
        rare = single_terms(counts, key, sent).join(tail, "h").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("h", "df"))).alias("v"))
        rows = counts.join(rare, key, "left").select(key, "h", "n", F.col("v.h").alias("rare"), F.col("v.df").alias("df"))

    def run(batches):
        for batch in batches:
            out = []
            for h, n, rare, df in zip(*(batch.column(c) for c in ("h", "n", "rare", "df")), strict=True):
                h, n = h.values.to_numpy(), n.values.to_numpy()
                found = sent.of(h)
                if rare.is_valid:
                    found[np.searchsorted(h, rare.values.to_numpy())] = df.values.to_numpy()
                found[found == 0] = 1
                w = n * (np.log((1 + n_docs) / (1 + found)) + 1)
                w, shared = w / np.sqrt(w @ w), found > 1
                out.append((h[shared], w[shared]))
            kinds = (pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([v[i] for v in out], pa.list_(k)) for i, k in enumerate(kinds))], names=[key, "h", "w"])

    return rows.mapInArrow(run, f"{key} {kind}, h array<long>, w array<double>")


def near_texts(docs: DataFrame, key: str, text: str, threshold: float, keep: Callable[[DataFrame], DataFrame], most_shared: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): (key, first, size) of each document whose text has terms, first being the smallest key with its text, and
    (a, b, cosine) of the firsts above the threshold.

    Weights count every document, but equal texts are one vector, so copies cost no pairs.  A document is the texts of its key.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("__h"))
    first = keep(rows.groupBy("__h").agg(F.min(key).alias("first"), F.count("*").alias("size")))
    n_docs = docs.select(key).distinct().count()
    if n_docs != docs.count():
        docs = docs.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(text)), "\n").alias(text))
    counts = keep(term_counts(docs, key, text))
    df = keep(counts.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"))
    heads = commonest(df)
    firsts = first.select(F.col("first").alias(key)).distinct()
    copies = sized(rows.select(key).distinct().join(firsts, key, "left_anti"))  # fewer than firsts, so that counts stay where they are
    own = counts.filter(F.col(key).isNotNull()).join(copies, key, "left_anti")
    blocks = keep(vector_blocks(unit_vectors(own, df, key, n_docs, most_shared), key, BLOCK))
    with_terms_ = keep(first.join(counts.select(F.col(key).alias("first")), "first", "left_semi"))
    discard(counts, df)
    classes = rows.join(with_terms_, "__h").select(key, "first", "size")
    return classes, block_cosines(blocks, threshold, heads)


def with_members(classes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """pairs of firsts, and (first, copy, 1) of each further document of a class: all links follow from these."""
    return pairs.unionByName(classes.filter(F.col(key) != F.col("first")).select(F.col("first").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("cosine")))


def link_counts(classes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, first, n_links): a row for each document, with how many others are near it, copies included."""
    both = pairs.select(F.col("a").alias("first"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("first"), F.col("a").alias("other")))
    others = both.groupBy("first").agg(F.count("*").alias("near"))  # combined before the shuffle; only copies are joined
    copied = classes.filter("size > 1").select(F.col("first").alias("other"), (F.col("size") - 1).alias("more")).distinct()
    copies = both.join(sized(copied), "other").groupBy("first").agg(F.sum("more").alias("copies"))
    near = F.col("size") - 1 + F.coalesce("near", F.lit(0)) + F.coalesce("copies", F.lit(0))
    return classes.join(others, "first", "left").join(copies, "first", "left").select(key, "first", near.alias("n_links"))


def cross_cosine(left: DataFrame, right: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, cosine) between two small sides (top sections of two products): an exact join on terms."""
    x, y = left.select(F.col(key).alias("a"), "term", F.col("w").alias("w_a")), right.select(F.col(key).alias("b"), "term", F.col("w").alias("w_b"))
    return x.join(y, "term").groupBy("a", "b").agg(F.round(F.sum(F.col("w_a") * F.col("w_b")), 12).alias("cosine")).filter(F.col("cosine") > threshold)


def greedy_rounds(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """One-to-one assignment (a, b, cosine) by rank, and the rounds it took: similarity descending, then a, then b.

    Deferred acceptance: each free left node offers its best edge that its right node would still take, and each right node keeps
    the best it was offered.  What a right node keeps only gets better, so a refused edge stays refused, and under one
    strict order of all edges the outcome equals taking edges one by one.  Edges are written once; a round reads those of
    free nodes and writes only nodes.
    """
    order = F.struct((-F.col("cosine")).alias("o"), "a", "b")
    given = keep(edges.select("a", "b", "cosine"))
    held, free, rounds = keep(given.limit(0)), keep(given.select("a").distinct()), 0
    while True:
        taken = held.select("b", order.alias("held"))
        open_ = given.join(sized(free), "a").join(taken, "b", "left").filter(F.col("held").isNull() | (order < F.col("held")))
        offers = keep(open_.groupBy("a").agg(F.min_by(F.struct("b", "cosine"), order).alias("e")).select("a", "e.b", "e.cosine"))
        if offers.isEmpty():
            discard(offers, free, given)
            return held, rounds
        rounds += 1
        now = keep(held.unionByName(offers).groupBy("b").agg(F.min_by(F.struct("a", "cosine"), order).alias("e")).select("e.a", "b", "e.cosine"))
        left = keep(held.select("a").unionByName(offers.select("a")).join(now.select("a"), "a", "left_anti"))
        discard(held, free, offers)
        held, free = now, left


def greedy_pairs(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return greedy_rounds(edges, keep)[0]


def keep_first(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes (id) kept so that none is near an earlier kept one: the sequential rule, in rounds.

    A node without an undecided earlier neighbour is kept; neighbours after a kept node are dropped.  What a round has decided is left
    out of the edges, which the next round reads.
    """
    edges = keep(edges.select("a", "b"))  # a < b
    later = keep(edges.select(F.col("b").alias("id")).distinct())
    open_, kept = nodes.join(later, "id"), nodes.join(later, "id", "left_anti")
    newly, open_ = kept, keep(open_)
    while True:
        dropped = edges.join(newly.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        before, open_ = open_, keep(open_.join(dropped, "id", "left_anti"))
        discard(before)
        if open_.isEmpty():
            discard(edges)
            return kept
        before, edges = edges, keep(edges.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
        discard(before)
        newly = keep(open_.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        kept = kept.unionByName(newly)
        before, open_ = open_, keep(open_.join(newly, "id", "left_anti"))
        discard(before)


def title_matches(left: DataFrame, right: DataFrame, keep: Callable[[DataFrame], DataFrame], least: float = 0.3, sure: float = 0.5) -> DataFrame:
    """For each left title (id, title) the right one of highest token Jaccard: O above 0.5, partial above 0.3, else X.

    Distinct sets of tokens are matched once.  Two sets above the threshold share one of their rarest tokens, so only
    these are joined: a token that most titles have brings no pairs.
    """
    words = F.array_sort(F.array_distinct(tokens(F.col("title"))))
    x = keep(left.select(F.col("id").alias("a"), words.alias("t_a")))
    y = keep(right.select("id", words.alias("t_b")).groupBy("t_b").agg(F.min("id").alias("b")))
    sets = x.select(F.col("t_a").alias("t")).unionByName(y.select(F.col("t_b").alias("t"))).distinct().filter(F.size("t") > 0)
    ranked = sets.select("t", F.explode("t").alias("w"))
    ranked = ranked.join(ranked.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("order"))
    # above the threshold more than least * size tokens are shared, so one of the first size - least * size ones is
    rare = keep(ranked.select("t", F.explode(F.slice("order", 1, F.size("t") - F.floor(least * F.size("t")).cast("int"))).alias("o")).select("t", F.col("o.w").alias("w")))
    near = rare.join(y, rare["t"] == y["t_b"], "left_semi").select(F.col("t").alias("t_b"), "w").join(rare.join(x, rare["t"] == x["t_a"], "left_semi").select(F.col("t").alias("t_a"), "w"), "w")
    near = near.select("t_a", "t_b").distinct().withColumn("similarity", F.round(T.jaccard(F.col("t_a"), F.col("t_b")), 6)).filter(F.col("similarity") > least)
    best = near.join(y, "t_b").groupBy("t_a").agg(F.max_by(F.struct("b", "similarity"), F.struct("similarity", -F.col("b"))).alias("best"))
    status = F.when(F.col("best.similarity") > sure, "O").when(F.col("best.similarity") > least, "△").otherwise("X")
    return x.join(best, "t_a", "left").select("a", F.col("best.b").alias("b"), F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"), status.alias("status"))


def groups_of(name: Column, synonyms: dict[str, list[str]]) -> Column:
    """Places of the synonym groups that a name hits."""
    return F.array_compact(F.array(*[F.when(T.has_any(name, [word, *variants]), F.lit(i)) for i, (word, variants) in enumerate(synonyms.items())]))


def shares_group(a: Column, b: Column, synonyms: dict[str, list[str]]) -> Column:
    """0.4 when both names hit the same synonym group."""
    return F.when(F.arrays_overlap(groups_of(a, synonyms), groups_of(b, synonyms)), 0.4).otherwise(0.0)


def synonym_pairs(names: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """(a, b) with a < b of distinct names (norm) that hit the same group; a group of very many names meets in parts."""
    hits = names.select("norm", F.explode(groups_of(F.col("norm"), synonyms)).alias("g"))
    return pairs_in_groups(hits, "g", "norm", []).distinct()


def candidate_pairs(names: DataFrame, synonyms: dict[str, list[str]], gram: int = 3) -> DataFrame:
    """(a, b) with a < b of distinct names (norm) that share a token or a group, or of which one contains the other.

    A name that contains another has its first characters somewhere, so containment is joined on these.  Other pairs have
    no similarity but the sequence ratio's, which is at most its weight.
    """
    words = names.select("norm", F.explode(F.array_distinct(F.filter(F.split("norm", r"\s+"), lambda w: w != ""))).alias("w"))
    by_word = pairs_in_groups(words, "w", "norm", [])
    begins = names.filter(F.length("norm") > 0).select(F.col("norm").alias("inner"), F.substring("norm", 1, gram).alias("g"))
    places = F.transform(F.sequence(F.lit(1), F.length("norm")), lambda i: F.array(*[F.substr(F.col("norm"), i, F.lit(n)) for n in range(1, gram + 1)]))
    grams = names.filter(F.length("norm") > 0).select(F.col("norm").alias("outer"), F.explode(F.array_distinct(F.flatten(places))).alias("g"))
    inside = begins.join(grams, "g").filter(F.col("outer").contains(F.col("inner"))).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
    found = by_word.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    return found.unionByName(synonym_pairs(names, synonyms)).distinct()


def block_pairs(left: DataFrame, right: DataFrame, blocks: int = 16) -> DataFrame:
    """All pairs of two tables of distinct values (a) and (b), where the pairs are the result, dealt into blocks x blocks by hashes.

    Tasks are equal and neither side is sent whole.
    """
    x = left.select("a", F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    y = right.select("b", F.pmod(F.xxhash64("b"), F.lit(blocks)).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"))
    return x.hint("merge").join(y, [x["i"] == y["i"], x["j"].cast("long") == y["j"]]).select("a", "b")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two names; no built-in function has this measure."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def name_similarity(a: Column, b: Column, synonyms: dict[str, list[str]], ratio_weight: float = 0.3) -> Column:
    """Equal 1, contained 0.9, else weighted sequence ratio and token Jaccard plus the synonym bonus, at most 1."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    score = 0.7 * T.jaccard(words(a), words(b)) + shares_group(a, b, synonyms)
    if ratio_weight:
        score = score + ratio_weight * sequence_ratio(a, b)
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.9).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


#: Names of a block, and names that may have a token for it to be used in a lower bound (which changes speed only).
NAMES_A_BLOCK, MOST_WITH_TOKEN = 1024, 1000
#: Similarities are rounded, so a bound has to be this much below to rule a pair out.
ROUNDING = 1e-6


class NameBlock:
    """Distinct names side by side, for upper bounds of their similarity to one other name.

    The sequence ratio is at most twice the number of characters that two names share, counted with repeats, over their total length.
    """

    def __init__(self, names: list[str], groups: list[list[int]]):
        self.names, self.length = names, np.array([len(a) for a in names], dtype=np.float64)
        self.place = {c: i for i, c in enumerate(sorted(set().union(*names)))}
        self.counts = np.zeros((len(names), len(self.place)), dtype=np.int16)
        self.n_words = np.zeros(len(names))
        self.with_word: dict[str, list[int]] = {}
        self.with_group: dict[int, list[int]] = {}
        for i, a in enumerate(names):
            for c in a:
                self.counts[i, self.place[c]] += 1
            words = set(a.split())
            self.n_words[i] = len(words)
            for w in words:
                self.with_word.setdefault(w, []).append(i)
            for g in groups[i]:
                self.with_group.setdefault(g, []).append(i)

    def bounds(self, b: str, groups: list[int], ratio_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(most, base, decided) for each name: an upper bound, the similarity without the ratio, and whether the bound is the similarity."""
        own = np.zeros(len(self.place), dtype=np.int16)
        for c in b:
            if c in self.place:
                own[self.place[c]] += 1
        shared = np.minimum(self.counts, own).sum(axis=1)
        both, words = np.zeros(len(self.names)), set(b.split())
        for w in words:
            both[self.with_word.get(w, [])] += 1
        base = 0.7 * both / np.maximum(self.n_words + len(words) - both, 1)
        bonus = np.zeros(len(self.names))
        for g in groups:
            bonus[self.with_group.get(g, [])] = 0.4
        base = base + bonus
        most = np.minimum(base + ratio_weight * 2 * shared / np.maximum(self.length + len(b), 1), 1.0)
        decided = np.zeros(len(self.names), dtype=bool)
        for i in np.flatnonzero(shared == np.minimum(self.length, len(b))).tolist():  # only such names may contain each other
            a = self.names[i]
            if a == b or a in b or b in a:
                most[i], decided[i] = 1.0 if a == b else 0.9, True
        return most, base, decided


def best_names(left: pa.Table, right: pa.Table, least: float, ratio_weight: float) -> pa.Table:
    """Of a block of names (a, g, own: products and ords) and one of features (b, g, known: similarities already reached by product)
    each product's best name for each feature, and how many pairs the sequence ratio was taken of.

    Names are tried from the highest bound down, while any can still change a product's best.
    """
    held = NameBlock(left.column("a").to_pylist(), left.column("g").to_pylist())
    own = [[(p["product"], p["ord"]) for p in ps] for ps in left.column("own").to_pylist()]
    products = {p for ps in own for p, _ in ps}
    out: list[tuple] = []
    for b, groups, known in zip(*(right.column(c).to_pylist() for c in ("b", "g", "known")), strict=True):
        most, base, decided = held.bounds(b, groups, ratio_weight)
        reached = {k["product"]: k["least"] for k in known or ()}
        best: dict[str, tuple[float, int, int]] = {}
        floor, compared = min(reached.get(p, 0.0) for p in products), 0
        for i in np.argsort(-most, kind="stable").tolist():
            bound = most[i] + ROUNDING
            if bound <= least or bound < floor:
                break
            if all(bound < max(reached.get(p, 0.0), best[p][0] if p in best else 0.0) for p, _ in own[i]):
                continue
            if decided[i]:
                value = float(most[i])
            elif ratio_weight:
                value, compared = float(base[i]) + ratio_weight * difflib.SequenceMatcher(None, b, held.names[i]).ratio(), compared + 1
            else:
                value = float(base[i])
            value = round(min(value, 1.0), 6)
            if value <= least:
                continue
            changed = False
            for p, ord_ in own[i]:
                if p not in best or (value, -ord_) > (best[p][0], -best[p][1]):
                    best[p], changed = (value, ord_, i), True
            if changed:
                floor = min(max(reached.get(p, 0.0), best[p][0] if p in best else 0.0) for p in products)
        out += [(p, b, value, ord_, held.names[i], 0) for p, (value, ord_, i) in best.items()]
        if compared:
            out.append((None, b, None, None, None, compared))
    kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.int64()]
    return pa.Table.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=["product", "feature", "similarity", "ord", "norm", "compared"])


def reached_similarities(own: DataFrame, merged: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """(b, known): for each feature the similarity that some name of a product has at least, from names that share a rare token."""
    words = lambda names, c: names.select(F.col("norm").alias(c), F.explode(F.array_distinct(F.filter(F.split("norm", r"\s+"), lambda w: w != ""))).alias("w"))
    of_names = words(own.select("norm").distinct(), "a")
    rare = of_names.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") <= MOST_WITH_TOKEN).select("w")
    pairs = of_names.join(rare, "w").join(words(merged, "b"), "w").select("a", "b").distinct()
    scored = pairs.withColumn("s", name_similarity(F.col("a"), F.col("b"), synonyms, 0))
    cells = scored.join(own.select(F.col("norm").alias("a"), "product"), "a").groupBy("b", "product").agg(F.max("s").alias("least"))
    return cells.groupBy("b").agg(F.collect_list(F.struct("product", "least")).alias("known"))


def best_by_product(own: DataFrame, merged: DataFrame, synonyms: dict[str, list[str]], least: float, ratio_weight: float) -> DataFrame:
    """(product, feature, similarity, ord, norm) of each product's best name, and rows without a product that count compared pairs.

    Names and features are dealt into blocks; every block meets every other, but a pair reaches the
    sequence ratio only where its bound can still change what is best.
    """
    names = own.groupBy("norm").agg(F.collect_list(F.struct("product", "ord")).alias("own"))
    blocks_of = lambda n: max(1, -(-n // NAMES_A_BLOCK))
    n_a, n_b = blocks_of(names.count()), blocks_of(merged.count())
    known = reached_similarities(own, merged, synonyms) if ratio_weight else merged.select(F.col("norm").alias("b"), F.array().cast("array<struct<product:string,least:double>>").alias("known")).limit(0)
    block = lambda n: F.pmod(F.xxhash64("norm"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = names.select(F.col("norm").alias("a"), groups_of(F.col("norm"), synonyms).alias("g"), "own", block(n_a).alias("i")).withColumn("j", every(n_b))
    y = merged.select(F.col("norm").alias("b"), groups_of(F.col("norm"), synonyms).alias("g"), block(n_b).alias("j")).join(known, "b", "left").withColumn("i", every(n_a))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"product": pa.array([], pa.string()), "feature": pa.array([], pa.string()), "similarity": pa.array([], pa.float64()), "ord": pa.array([], pa.int64()), "norm": pa.array([], pa.string()), "compared": pa.array([], pa.int64())})
        return best_names(left, right, least, ratio_weight)

    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(run, "product string, feature string, similarity double, ord long, norm string, compared long")


def support_matrix(
    catalogue: DataFrame, merged: DataFrame, synonyms: dict[str, list[str]], keep: Callable[[DataFrame], DataFrame], least: float = 0.05, ratio_weight: float = 0.3
) -> DataFrame:
    """(product, feature, status, similarity, description, source_url, confidence): each product's best feature for each merged one.

    `catalogue` has (product, norm, ord, description, url, confidence), `merged` (norm).  Of features alike the first by ord is
    best.  Distinct names are scored once, whatever the number of products.  keep writes a table that is read several times.
    """
    own = keep(catalogue.groupBy("product", "norm").agg(F.min_by(F.struct("ord", "description", "url", "confidence"), "ord").alias("row")))
    found = best_by_product(own.select("product", "norm", "row.ord"), keep(merged.select("norm").distinct()), synonyms, least, ratio_weight).filter("product IS NOT NULL")
    best = found.groupBy("product", "feature").agg(F.max_by(F.struct("norm", "similarity"), F.struct("similarity", F.negative("ord"))).alias("best"))
    best = best.select("product", "feature", "best.norm", "best.similarity").join(own, ["product", "norm"])
    cells = block_pairs(merged.select(F.col("norm").alias("a")).distinct(), own.select(F.col("product").alias("b")).distinct()).select(F.col("a").alias("feature"), F.col("b").alias("product"))
    has = F.col("similarity").isNotNull()
    return cells.join(best, ["product", "feature"], "left").select(
        "product", "feature", F.when(has, "O").otherwise("X").alias("status"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("row.description", F.lit("")).alias("description"), F.coalesce("row.url", F.lit("")).alias("source_url"), F.coalesce("row.confidence", F.lit(0.0)).alias("confidence"),
    )


def longest_shared(a: Column, b: Column) -> Column:
    """Longest common token of two texts, then the smallest; else the first 20 characters of a."""
    both = F.array_sort(F.transform(F.array_intersect(tokens(a), tokens(b)), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.coalesce(F.get(both, F.lit(0))["t"], F.substring(a, 1, 20))


def shared_keyword(a: Column, b: Column, terms: list[str]) -> Column:
    """Longest lexicon term that both texts have, then the smallest; else the first term of either; else a general word."""
    x, y = T.terms_in(F.lower(a), terms), T.terms_in(F.lower(b), terms)
    both = F.array_sort(F.transform(F.array_intersect(x, y), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.coalesce(F.get(both, F.lit(0))["t"], F.get(x, F.lit(0)), F.get(y, F.lit(0)), F.lit("기능"))


def pair_verdicts(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Both sides' verdict, confidence and cut text."""
    out = pairs.withColumns({"v1": scoring.polarity(F.col(left)), "v2": scoring.polarity(F.col(right))})
    return out.select(*[c for c in pairs.columns if c not in (left, right)], F.col("v1.status").alias("status_1"), F.col("v2.status").alias("status_2"), F.col("v1.confidence").alias("confidence_1"), F.col("v2.confidence").alias("confidence_2"), T.cut(F.col(left), 100).alias("text_1"), T.cut(F.col(right), 100).alias("text_2"))


#: Stands in every chunk, so that the number of its documents is that of the chunks; a term has two characters at least.
EVERYWHERE = ""


def chunk_similarity(docs: DataFrame, features: DataFrame, key: str, text: str, keep: Callable[[DataFrame], DataFrame], size: int = 500, most_shared: int = MOST_SHARED) -> DataFrame:
    """(key, feature, similarity): the best cosine of a feature with a document's chunks.

    Chunks are read twice, for documents of terms and for norms, and no term of a chunk is written or shuffled but those of several chunks
    beyond the most_shared commonest, with those of one chunk.  Of a chunk only its norm and the features' own terms go further.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    chunks = docs.select(key, F.posexplode(scoring.word_chunks(F.col(text), size, 50)).alias("chunk", "t")).select(F.struct(key, "chunk").alias("id"), "t")
    if docs.select(key).distinct().count() != docs.count():  # a chunk is the texts of its key and place
        chunks = chunks.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias("t"))
    hashed = F.array_distinct(F.transform(tokens(F.col("t")), lambda t: F.xxhash64(t)))
    each = chunks.select(F.explode(F.concat(F.array(F.xxhash64(F.lit(EVERYWHERE))), hashed)).alias("h"))
    df = keep(each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"))
    n_chunks = max([1, *(r.df for r in df.filter(F.col("h") == F.xxhash64(F.lit(EVERYWHERE))).collect())])
    wanted = features.select("feature", F.explode(F.array_distinct(tokens(F.col("feature")))).alias("term"))
    wanted = wanted.select("feature", F.xxhash64("term").alias("h"), (1 / F.sqrt(F.count("*").over(Window.partitionBy("feature")))).alias("u"))
    head, tail = commoner(df, most_shared)
    known = keep(wanted.select("h").distinct().join(df, "h", "left").select("h", F.coalesce("df", F.lit(1).cast("long")).alias("df")))
    asked = np.sort(np.array([r.h for r in known.collect()], dtype=np.int64))
    sent, rare = SentCounts(head.join(sized(known), "h", "left_anti").unionByName(known)), tail is not None
    kind = dict(chunks.dtypes)["id"]

    def run(batches):
        for batch in batches:
            kept, squares, out = [], [], []
            for i, (h, n) in enumerate(zip(batch.column("h"), batch.column("n"), strict=True)):
                h, n = h.values.to_numpy(), n.values.to_numpy()
                hit = np.isin(h, asked)
                if not hit.any():
                    continue
                found = sent.of(h)
                rest = (found == 0) & rare  # of one chunk, or of few
                w = n * (np.log((1 + n_chunks) / (1 + np.maximum(found, 1))) + 1)
                w[rest] = 0.0
                kept.append(i)
                squares.append(w @ w)
                out.append((h[hit], w[hit], h[rest], n[rest]))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array([v[j] for v in out], pa.list_(k)) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept, pa.int64())), pa.array(squares, pa.float64()), *columns], names=["id", "squares", "h", "w", "rest", "n"])

    vectors = term_counts(chunks, "id", "t").mapInArrow(run, f"id {kind}, squares double, h array<long>, w array<double>, rest array<long>, n array<long>")
    if rare:
        vectors = keep(vectors)
        single = vectors.select("id", F.explode(F.arrays_zip("rest", "n")).alias("x")).select("id", F.col("x.rest").alias("h"), "x.n").join(tail, "h", "left")
        w = F.col("n") * (F.log((1 + F.lit(n_chunks)) / (1 + F.coalesce("df", F.lit(1)))) + 1)
        vectors = vectors.join(single.groupBy("id").agg(F.sum(w * w).alias("more")), "id", "left").withColumn("squares", F.col("squares") + F.coalesce("more", F.lit(0.0)))
    hit = vectors.select("id", F.sqrt("squares").alias("norm"), F.explode(F.arrays_zip("h", "w")).alias("x")).select("id", "norm", "x.h", "x.w").join(sized(wanted), "h")
    cosine = hit.groupBy("id", "feature").agg(F.sum(F.col("w") / F.col("norm") * F.col("u")).alias("cosine"))
    return cosine.groupBy(F.col(f"id.{key}").alias(key), "feature").agg(F.round(F.max("cosine"), 6).alias("similarity"))
