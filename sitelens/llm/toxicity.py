"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features are rates, not word vectors: densities of a learnt lexicon of words and of word stems, as written and with
look-alike characters undone, their closeness to second-person words, capitals, punctuation and obfuscation.
The lexicon, the trees and the calibration are fitted on a bounded labelled sample.

Edge cases: null and empty texts have all-zero features and are scored like any other; without labelled rows of both
classes every score is 0; a label given twice for an id counts by its maximum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import labelled_sample
from .common import tidy
from .textblocks import RangeHash, Words, as_long, text_blocks

#: Bound on the labelled documents of a class that are fitted on.
SAMPLE_PER_CLASS = 4000
#: Bound on the learnt lexicon; units must be in this share of the toxic sample, and this many times likelier there.
LEXICON = 400
LEAST_SHARE = 0.01
LEAST_RATIO = 8.0
#: ... and its toxic documents times the logarithm of that ratio must reach this, so a few chance meetings don't count.
LEAST_WEIGHT = 12.0
STEMS = (4, 5, 6)
NEAR = 5

#: Second-person words of the corpus languages.
SECOND_PERSON = "you your yours yourself ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split()

FEATURES = [
    "word_density", "stem_density", "plain_word_density", "plain_stem_density", "word_hits", "stem_hits", "near_second_person",
    "second_person", "capitals", "capital_words", "punctuation", "exclamation", "obfuscated", "digits", "log_words",
]

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PLAIN = np.arange(256, dtype=np.uint8)
for _seen, _meant in zip(b"013457@$!|", b"oieastasii", strict=True):
    _PLAIN[_seen] = _meant


class Units:
    """Trimmed words of a block: hashes of the words and of their stems, as written (lower case) and in plain letters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        self.raw, self.doc, self.count, self.n_docs = data, words.doc, words.count, len(offsets) - 1
        self.whole = (words.start, words.end)
        start, end = words.start.copy(), words.end.copy()
        for _ in range(4):
            end -= ~_ALNUM[data[end - 1]] & (end - start > 1)
            start += ~_ALNUM[data[start]] & (end - start > 1)
        self.start, self.end = start, end
        self.lower = words.ranges
        self.plain = RangeHash(_PLAIN[words.data])

    def word(self, plain: bool = False) -> np.ndarray:
        return (self.plain if plain else self.lower).of(self.start, self.end)

    def stem(self, length: int, plain: bool = False) -> np.ndarray:
        """Hash of the first bytes of longer words, 0 for others."""
        longer = self.end - self.start > length
        return np.where(longer, (self.plain if plain else self.lower).of(self.start, np.minimum(self.start + length, self.end)), np.uint64(0))


def _member(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of) or not len(h):
        return np.zeros(len(h), dtype=bool)
    at = np.searchsorted(of, h)
    return of[np.minimum(at, len(of) - 1)] == h


def _word_hashes(words: list[str]) -> np.ndarray:
    _, data, offsets = next(text_blocks(pa.array(words)))
    return np.unique(Units(data, offsets).word())


def feature_matrix(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, stems: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document of a block."""
    u = Units(data, offsets)
    n = np.maximum(u.count, 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    by_doc = lambda flag: np.bincount(u.doc[flag], minlength=u.n_docs).astype(float)
    any_stem = lambda plain: np.logical_or.reduce([_member(u.stem(k, plain), stems) for k in STEMS])
    word, plain_word, stem, plain_stem = _member(u.word(), words), _member(u.word(True), words), any_stem(False), any_stem(True)
    hit, you = word | plain_word | stem | plain_stem, _member(u.word(), second)
    at, close = np.flatnonzero(you), np.zeros(len(hit), dtype=bool)
    for shift in range(-NEAR, NEAR + 1):
        to = at + shift
        ok = (to >= 0) & (to < len(hit))
        ok[ok] = u.doc[to[ok]] == u.doc[at[ok]]
        close[to[ok]] = True
    bytes_at = lambda flag: np.add.reduceat(np.append(flag[data], 0).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0)
    upper_before = np.concatenate([[0], np.cumsum(_UPPER[data])])
    odd_before = np.concatenate([[0], np.cumsum(~_ALNUM[data] | _DIGIT[data])])
    letters = u.end - u.start
    capital = (upper_before[u.end] - upper_before[u.start] == letters) & (letters > 2)
    odd = odd_before[u.end] - odd_before[u.start]
    mark = np.zeros(256, dtype=bool)
    mark[[33, 63]] = True
    punctuation = ~_ALNUM.copy()
    punctuation[[9, 10, 11, 12, 13, 32]] = False
    return np.column_stack([
        by_doc(word) / n, by_doc(stem) / n, by_doc(plain_word) / n, by_doc(plain_stem) / n, np.log1p(by_doc(word | plain_word)), np.log1p(by_doc(stem | plain_stem)),
        by_doc(hit & close) / n, by_doc(you) / n, bytes_at(_UPPER) / size, by_doc(capital) / n, bytes_at(punctuation) / size, bytes_at(mark) / size,
        by_doc((odd > 0) & (odd < letters)) / n, bytes_at(_DIGIT) / size, np.log1p(u.count),
    ])


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, stem hashes) that are far likelier in toxic sample documents; counted by document."""

    def units(batches):
        for batch in batches:
            y = np.asarray(batch.column("y"))
            parts = []
            for first, data, offsets in text_blocks(batch.column("text")):
                u = Units(data, offsets)
                for kind, h in [(0, u.word()), *((1, u.stem(k)) for k in STEMS)]:
                    pair = np.unique(np.column_stack([h, u.doc.astype(np.uint64)])[h != 0], axis=0)
                    parts.append((np.full(len(pair), kind, dtype=np.int32), pair[:, 0], y[first + pair[:, 1].astype(np.int64)]))
            if parts:
                kind, h, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(as_long(h)), pa.array(toxic.astype(np.int64))], names=["kind", "unit", "y"])

    found = sample.select("text", "y").distinct().mapInArrow(tidy(units), "kind int, unit long, y long")
    n = sample.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).first()
    toxic, clean = float(n["toxic"] or 0), float(n["clean"] or 0)
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    counted = found.groupBy("kind", "unit").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    best = counted.filter((F.col("toxic") >= LEAST_SHARE * toxic) & (ratio >= LEAST_RATIO) & (F.col("toxic") * F.log(ratio) >= LEAST_WEIGHT)).orderBy(F.desc(F.col("toxic") * F.log(ratio)), "kind", "unit").limit(LEXICON)
    rows = best.collect()
    pick = lambda kind: np.unique(np.array([r["unit"] for r in rows if r["kind"] == kind], dtype=np.int64).view(np.uint64))
    return pick(0), pick(1)


def with_features(docs: DataFrame, words: np.ndarray, stems: np.ndarray) -> DataFrame:
    """The columns of docs without text, then the features."""
    kept = [c for c in docs.columns if c != "text"]
    second = _word_hashes(SECOND_PERSON)
    names = [*kept, *FEATURES]

    def run(batches):
        for batch in batches:
            blocks = [feature_matrix(data, offsets, words, stems, second) for _, data, offsets in text_blocks(batch.column("text"))]
            x = np.vstack(blocks) if blocks else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(FEATURES)))], names=names)

    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(f, T.DoubleType()) for f in FEATURES)])
    return docs.mapInArrow(tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = SAMPLE_PER_CLASS) -> dict | None:
    """Lexicon, trees and calibration from at most 2 x per_class labelled texts; None without both classes.

    A quarter of the sample is kept out of the lexicon and the trees, for the calibration.
    """
    sample = labelled_sample(docs, labels, "toxic", usable, per_class).withColumn("part", F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string"))) % 4)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    total = {r["y"]: r["n"] for r in labels.filter(usable).groupBy(F.col("toxic").alias("y")).agg(F.count("*").alias("n")).collect()}
    words, stems = learn_lexicon(sample.filter("part > 0"))
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(sample, words, stems))
    x = x.withColumn("y", F.col("y").cast("double")).withColumn("weight", F.when(F.col("y") == 1, total[1] / sizes[1]).otherwise(total[0] / sizes[0])).persist()
    fitting, holding = x.filter("part > 0"), x.filter("part = 0")
    if fitting.select("y").distinct().count() < 2 or holding.select("y").distinct().count() < 2:
        fitting = holding = x
    trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=15, maxDepth=3, stepSize=0.3, seed=5).fit(fitting)
    raw = trees.transform(holding).withColumn("raw", vector_to_array("probability")[1])
    curve = IsotonicRegression(featuresCol="raw", labelCol="y", weightCol="weight", predictionCol="share").fit(raw)
    x.unpersist()
    return {"words": words, "stems": stems, "trees": trees, "curve": curve}


def score_toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """The columns of docs without text (and without a score that they have), then `score` (0 to 1, higher: toxic).

    The calibrated share carries the score; a hundredth of it is the trees' own probability, which orders equal shares.
    """
    kept = [c for c in docs.columns if c not in ("text", "score")]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias("score"))
    own = [f"__own{i}" for i in range(len(kept))]  # no name of a feature or of a model's column
    x = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)], "text")
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(x, model["words"], model["stems"]))
    raw = model["trees"].transform(x).withColumn("raw", vector_to_array("probability")[1])
    share = model["curve"].transform(raw)
    score = F.least(F.greatest(0.99 * F.col("share") + 0.01 * F.col("raw"), F.lit(0.0)), F.lit(1.0))
    return share.select(*[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], score.alias("score"))
