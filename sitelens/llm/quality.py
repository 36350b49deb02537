"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks, each compressed once with either dictionary; the difference and the mean of the two sizes,
divided by the plain size, are calibrated to a probability by logistic regression on labelled rows that the
dictionaries have not seen.

Edge cases: null and empty texts score as an average text does; unlabelled rows are scored like
others; without labelled rows of both classes every score is 0.5; a label given twice for an id counts by its maximum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy, written

#: Bound on the labelled documents of a class that are fitted on; half make dictionaries, half calibrate.
SAMPLE_PER_CLASS = 1500
#: Bytes of a dictionary: a bound on the texts that enter it, which do so whole.
DICTIONARY_BYTES = 1 << 20
BLOCK_BYTES = 512
LEVEL = 6


class CompressedSizes:
    """Per byte of a text, over all its blocks: (size with the bad dictionary - size with the good one, mean of both)."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL, block: int = BLOCK_BYTES):
        self.block = block
        self.of = []
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.of.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        with_good = with_bad = 0
        good, bad = self.of
        for at in range(0, len(text), self.block):
            part = text[at : at + self.block]
            with_good += len(good.compress(part))
            with_bad += len(bad.compress(part))
        return (with_bad - with_good) / len(text), (with_bad + with_good) / (2 * len(text))


def dictionary(texts: list[bytes]) -> bytes:
    """Dictionary content: whole texts end to end, which zstandard needs some bytes of."""
    return b"\n".join(texts).ljust(8, b"\0")


def fitting_texts(texts: DataFrame, size: int = DICTIONARY_BYTES) -> DataFrame:
    """Of labelled texts (doc_id, y, text) those that a dictionary of each class holds: whole ones, in order of a hash, until it is full.

    The window runs over the bounded sample; a text that alone would fill a quarter is left to the calibration.
    """
    line = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    bytes_ = F.octet_length("text") + 1
    return texts.filter(bytes_ <= size // 4).withColumn("end", F.sum(bytes_).over(line)).filter(F.col("end") <= size).drop("end")


#: The mean size is taken as so many deviations from the calibration's mean at most: texts that stand in a dictionary compress to nothing.
MOST_DEVIATIONS = 3.0


def standardised(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = (x - centre) / scale
    z[:, 1] = np.clip(z[:, 1], -MOST_DEVIATIONS, MOST_DEVIATIONS)
    return z


def calibrate(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps: coefficients of the standardised columns, then the intercept."""
    design = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(design.shape[1]), np.array([1e-3] * x.shape[1] + [1e-9]) * len(x)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if abs(step).max() < 1e-9:
            break
    return [float(v) for v in beta]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> DataFrame:
    """At most per_class labelled documents of either class, chosen by a hash of the id: (doc_id, text, y).

    The sample is drawn from the label table alone, so its join to the documents may be broadcast: 2 x per_class rows.
    """
    known = labels.filter(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    drawn = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(7), F.col("doc_id")), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), "y")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Dictionaries and calibration from a bounded labelled sample of 2 x per_class whole texts.

    The dictionaries hold whole texts until they are full.  Tasks measure the calibration rows; the driver gets the dictionaries'
    bytes and two numbers a row.
    """
    known = labels.filter(usable & F.col("quality").isin(0, 1)).agg(F.avg("quality").alias("share"), F.count("*").alias("n")).first()
    sample = labelled_sample(docs, labels, "quality", usable, per_class)
    # repeated ids may match several rows: one text for each id keeps the sample bounded
    once = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"), (F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string"))) % 2).alias("half"))
    texts = written(once.filter(F.octet_length("text") > 0), True)
    counts = {(r["y"], r["half"]) for r in texts.groupBy("y", "half").count().collect()}
    if len({y for y, _ in counts}) < 2:
        return {"good": b"\0" * 8, "bad": b"\0" * 8, "beta": [0.0, 0.0, 0.0], "centre": [0.0, 0.0], "scale": [1.0, 1.0]}
    held = fitting_texts(texts.filter("half = 0").select("doc_id", "y", "text")).orderBy("doc_id").collect()  # two dictionaries' bytes at most
    good, bad = (dictionary([r["text"].encode("utf-8", "surrogatepass") for r in held if r["y"] == want]) for want in (1, 0))

    def measured(batches):
        measure = CompressedSizes(good, bad)
        for batch in batches:
            x = np.array([measure(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "y", "apart", "mean"])

    kinds = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, y int"
    unseen = texts.filter("half = 1") if any(half == 1 for _, half in counts) else texts
    held = unseen.select("doc_id", "y", "text").mapInArrow(tidy(measured), f"{kinds}, apart double, mean double").orderBy("doc_id").collect()
    x, y = np.array([(r["apart"], r["mean"]) for r in held]), np.array([r["y"] for r in held])
    centre, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    beta = calibrate(standardised(x, centre, scale), y)
    # the sample is balanced by class: move the intercept to the share of good rows among all labels
    among, drawn = min(max(float(known["share"]), 1e-6), 1 - 1e-6), min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    beta[-1] += float(np.log(among / (1 - among)) - np.log(drawn / (1 - drawn)))
    return {"good": good, "bad": bad, "beta": beta, "centre": centre.tolist(), "scale": scale.tolist()}


def score_quality(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """Adds `score` (0 to 1, higher: good), or as named, to documents; every other column is kept as it is."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    names = [*docs.columns, name]
    at = docs.columns.index("text")

    def run(batches):
        measure, beta = CompressedSizes(model["good"], model["bad"]), np.array(model["beta"])
        centre, scale = np.array(model["centre"]), np.array(model["scale"])
        for batch in batches:
            x = np.array([measure(t) if t else centre for t in batch.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(standardised(x, centre, scale) @ beta[:2] + beta[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=names)

    return docs.mapInArrow(tidy(run), schema)
