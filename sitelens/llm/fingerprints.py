"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and the least hash of all, whatever the
size of the text.  The sketch of a union is the union of the sketches (of the values above the threshold only the
least stays), so sketches can be merged and containment estimated however unequal their texts are.

Edge cases: null and empty texts have the empty sketch, like only each other; of texts with no hash below the threshold
only the least hash is known, and they are like others that have the same one; null ids order as the smallest; repeated
rows follow each other; a single document follows itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .textblocks import Words, text_blocks

SHINGLE = 5
#: One in so many hashes is kept.
FRACTION = 2
_TOP = 1 << 32


def threshold_of(fraction: int) -> int:
    return _TOP // fraction


def sketch_of(hashes: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """Ascending values of one document's shingle hashes, on a 32-bit scale: those below the threshold, and the least."""
    values = np.unique((hashes >> np.uint64(32)).astype(np.int64))
    return values[: max(1, int(np.searchsorted(values, threshold_of(fraction))))]


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    values = np.union1d(a, b)
    return values[: max(1, int(np.searchsorted(values, threshold_of(fraction))))]


def likeness(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> float:
    """Estimated share of the smaller shingle set that the other contains; two empty sketches are alike."""
    x, y = (s[: np.searchsorted(s, threshold_of(fraction))] for s in (a, b))
    if len(x) and len(y):
        return len(np.intersect1d(x, y, assume_unique=True)) / min(len(x), len(y))
    return float(len(a) == len(b) == 0 or (len(a) > 0 and len(b) > 0 and a[0] == b[0]))


def as_text(sketch: np.ndarray, fraction: int = FRACTION) -> str:
    return f"{fraction}:" + sketch.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text.partition(":")[2]), dtype=">u4").astype(np.int64)


def sketches(texts: list[str], shingle: int = SHINGLE, fraction: int = FRACTION) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, data, offsets in text_blocks(pa.array(texts, pa.string())):
        hashes, at = Words(data, offsets).shingles(shingle)
        out += [sketch_of(hashes[a:b], fraction) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many, or all, of the following text's first."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_following(docs: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """Documents dealt into ranges of doc_id, each range followed by the document that comes after it.

    Split points are actual ids from quantiles of the id column.  The first document of a range (in descending order)
    is therefore known beforehand and is sent along, as a guest, to the range that comes just before; the
    first of all is the guest of the last range.  Texts are moved once and no range depends on another.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    share = [i / buckets for i in range(1, buckets)] + [1.0]
    split = docs.agg(F.percentile_approx("key", share, max(10_000, 20 * buckets)).alias("at"), F.max("key").alias("last")).first()
    splits = np.unique(np.asarray([*(split["at"] or []), *([split["last"]] if split["last"] is not None else [])], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, keys.to_numpy(dtype=np.int64)).astype(np.int32))

    @F.pandas_udf("boolean")
    def leads(keys: pd.Series) -> pd.Series:
        return pd.Series(np.isin(keys.to_numpy(dtype=np.int64), splits))

    own = docs.withColumn("range", range_of("key")).withColumn("leads", leads("key"))
    n = max(1, len(splits))
    guest = F.when(F.col("leads"), F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("range") + 1, F.lit(n)).alias("range"), F.lit(True).alias("guest"))))
    own = own.withColumn("to", F.explode(F.coalesce(guest, F.array(F.struct(F.col("range"), F.lit(False).alias("guest"))))))
    dealt = own.select("doc_id", "text", "key", F.col("to.range").alias("range"), F.col("to.guest").alias("guest"))
    return dealt.repartition("range").sortWithinPartitions("range", "guest", F.desc("key"), F.desc("text")), "range"


def fingerprint_documents(docs: DataFrame, shingle: int = SHINGLE, fraction: int = FRACTION, buckets: int | None = None) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    edited_sha256 is of the text whose last third is replaced by the start of the document next in descending doc_id.
    Batches are streamed: a task holds one batch and one carried document.
    """
    spark = docs.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt, _ = with_following(docs, buckets)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        held: list = []  # the last row so far: its follower may be in the next batch
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), ("" if t is None else t for t in batch.column("text").to_pylist()), batch.column("range").to_pylist(), batch.column("guest").to_pylist(), strict=True))
            made = sketches([r[1] for r in rows], shingle, fraction)
            rows = held + [(*r, s) for r, s in zip(rows, made, strict=True)]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[2] == b[2] and not a[3]]
            held = rows[-1:]
            changed = [edited(a[1], b[1]) for a, b in pairs]
            their = sketches(changed, shingle, fraction)
            columns = [
                pa.array([a[0] for a, _ in pairs], pa.int64()),
                pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array([as_text(a[4], fraction) for a, _ in pairs], pa.string()),
                pa.array([as_text(s, fraction) for s in their], pa.string()),
                pa.array([likeness(a[4], s, fraction) for (a, _), s in zip(pairs, their, strict=True)], pa.float64()),
                pa.array([likeness(a[4], b[4], fraction) for a, b in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.select("doc_id", "text", "range", "guest").mapInArrow(tidy(run), schema)
