"""Training-order materialisation: fixed-length token sequences in the order of a keyed permutation, in binary files.

Documents are encoded to token ids and cut into sequences of `length`; sequences are numbered densely, and a keyed
Feistel network with cycle-walking maps each number to its own slot of the training order.  The permutation needs only
the number of sequences and the key.  Each range of per_shard slots is one file whose records all have the same
stride, so slot s is at byte (s mod per_shard) * stride of file s div per_shard and reading can resume anywhere.

The numbering depends on the documents alone: they are dealt into buckets by a hash, as many as their count asks for, and
numbered in order of id and content within each, whatever the number of partitions.  Sequences are written once, with their
number in the bucket; how many come before a bucket is known then, and slots are computed on the way to the files.  A file is written under a name of its task's own and
then renamed, so a task that runs again leaves the same file.

Edge cases: null and empty texts have no sequence; the last sequence of a text is padded; repeated rows have sequences
of their own; ids may be null; other columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import WORK, discard, shared_dir, tidy, written
from .textblocks import mix

LENGTH = 512
PER_SHARD = 16_384
KEY = 20_240_607
ROUNDS = 4
#: Files are written in so many turns, so that the sequences of one turn only are in a shuffle while the files fill the disk.
TURNS = 2
#: Texts of fewer bytes are encoded whole where they are read; without decoded texts they take little room.
LONG_TEXT = 1 << 20
#: Documents are numbered in buckets, whose number follows that of the documents.
DOCS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1024, 64, 65_536
#: Token ids are little-endian unsigned 16-bit; PAD, which no tokenizer file used here has, fills the end of a text's last sequence.
PAD = 65_535


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Permutation of range(n): a balanced Feistel network over the next even power of two, walked until below n."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = x.astype(np.uint64)
    walk = np.ones(len(out), dtype=bool)
    while walk.any():
        left, right = out[walk] >> shift, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walk] = (left << shift) | right
        walk = out >= np.uint64(n)
    return out.astype(np.int64)


def bucket_count(n_docs: int) -> int:
    """Buckets for so many documents: a power of two with some thousand documents in each, at most MOST_BUCKETS."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, n_docs // DOCS_A_BUCKET - 1).bit_length()))


def sequences_of(docs: DataFrame, path: str, length: int = LENGTH, key: int = KEY) -> tuple[DataFrame, np.ndarray]:
    """(table, before): the written sequences (bucket, number, doc_id, sequence, n_tokens, tokens) of documents (doc_id, text), and how
    many come before each bucket's, and in all.

    The number counts within the bucket.  The driver holds a number for each bucket, MOST_BUCKETS at most.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = bucket_count(docs.count())
    ids = bpe.encode_documents(docs, path, long_text=LONG_TEXT, decode=False, narrow=True).filter("n_tokens > 0").select("doc_id", "ids", F.xxhash64("ids").alias("h"))
    dealt = ids.withColumn("bucket", F.pmod(F.xxhash64(F.lit(key), "doc_id", "h"), F.lit(buckets)).cast("int"))

    def cut(batches):
        bucket_now, number = -1, 0  # where the numbering of the last bucket goes on
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bucket", "ids")), strict=True):
                number = number if bucket == bucket_now else 0
                bucket_now = bucket
                for i, a in enumerate(range(0, len(data), 2 * length)):
                    part = data[a : a + 2 * length]
                    out.append((bucket, number, doc_id, i, len(part) // 2, part))
                    number += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "number", "doc_id", "sequence", "n_tokens", "tokens"])

    ordered = dealt.select("doc_id", "bucket", "h", "ids").repartition("bucket").sortWithinPartitions("bucket", "doc_id", "h", "ids")
    made = ordered.select("doc_id", "bucket", "ids").mapInArrow(tidy(cut), "bucket int, number long, doc_id long, sequence long, n_tokens long, tokens binary")
    sequences = written(made, codec="zstd")
    before = np.zeros(buckets + 1, dtype=np.int64)
    for r in sequences.groupBy("bucket").agg(F.max("number").alias("last")).collect():
        before[r["bucket"] + 1] = r["last"] + 1
    return sequences, np.cumsum(before)


def with_slots(sequences: DataFrame, before: np.ndarray, key: int = KEY, first: int = 0, end: int | None = None) -> DataFrame:
    """slot, the place in the training order, instead of bucket and number; of slots from first to before end only."""
    total, rest = int(before[-1]), [c for c in sequences.columns if c not in ("bucket", "number")]
    end = total if end is None else end

    def run(batches):
        for batch in batches:
            dense = before[batch.column("bucket").to_numpy()] + batch.column("number").to_numpy()
            slots = feistel(dense, total, key)
            made = pa.RecordBatch.from_arrays([pa.array(slots), *(batch.column(c) for c in rest)], names=["slot", *rest])
            yield made if first <= 0 and end >= total else made.filter(pa.array((slots >= first) & (slots < end)))

    return sequences.mapInArrow(tidy(run), T.StructType([T.StructField("slot", T.LongType()), *(sequences.schema[c] for c in rest)]))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.u16"


def write_shards(docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> tuple[DataFrame, DataFrame, str]:
    """(index, shards, folder): writes the files of documents (doc_id, text) into a new folder beside the checkpoints.

    index: (doc_id, sequence, n_tokens, slot, shard, byte_offset), one row for each sequence.
    shards: (shard, first_slot, records, n_bytes, sha256), one row for each file, as written.
    """
    folder = f"{shared_dir(docs.sparkSession)}/{WORK}{uuid.uuid4().hex}-shards"
    sequences, before = sequences_of(docs, path, length, key)
    shard = F.floor(F.col("slot") / per_shard)
    names = ["shard", "first_slot", "records", "n_bytes", "sha256"]

    def pack(batches):
        files, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        now, at, held = None, "", None
        done: list[tuple] = []

        def close():
            held.close()
            files.move(at, f"{root}/{shard_name(now)}")
            done.append((now, now * per_shard, records, records * length * 2, digest.hexdigest()))

        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if shard != now:
                    if now is not None:
                        close()
                    now, at, records, digest = shard, f"{root}/_{uuid.uuid4().hex}", 0, hashlib.sha256()
                    held = files.open_output_stream(at)
                record = np.full(length, PAD, dtype="<u2")
                record[: len(data) // 2] = np.frombuffer(data, dtype="<u2")
                held.write(record.tobytes())
                digest.update(record.tobytes())
                records += 1
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)

    turns = []
    step = max(1, -(-int(before[-1]) // (TURNS * per_shard))) * per_shard
    for at in range(0, max(1, int(before[-1])), step):
        placed = with_slots(sequences.select("bucket", "number", "tokens"), before, key, at, at + step).withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "slot")
        turns.append(written(placed.select("shard", "tokens").mapInArrow(tidy(pack), "shard long, first_slot long, records long, n_bytes long, sha256 string")))
    shards = functools.reduce(DataFrame.unionByName, turns)
    index = with_slots(sequences.drop("tokens"), before, key).select("doc_id", "sequence", "n_tokens", "slot", shard.alias("shard"), (F.pmod("slot", F.lit(per_shard)) * (2 * length)).alias("byte_offset"))
    index = written(index)
    discard(sequences)
    return index, shards, folder


def record_digests(spark, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, record_sha256) of every record in the files of a folder, read back by Spark."""
    stride = 2 * length

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                first = int(name.rsplit("-", 1)[1].split(".")[0]) * per_shard
                n = len(data) // stride
                digests = [hashlib.sha256(data[i * stride : (i + 1) * stride]).hexdigest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(digests, pa.string())], names=["slot", "record_sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.u16").load(folder)
    return files.select("path", "content").mapInArrow(tidy(run), "slot long, record_sha256 string")


def read_records(folder: str, first_slot: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Records from a slot on, in training order: opens only the files from that slot's on, at its byte."""
    files, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
    slot, stride = first_slot, 2 * length
    while files.get_file_info(name := f"{root}/{shard_name(slot // per_shard)}").type == pa.fs.FileType.File:
        with files.open_input_file(name) as held:
            held.seek(slot % per_shard * stride)
            while len(data := held.read(stride)) == stride:
                yield np.frombuffer(data, dtype="<u2")
                slot += 1
        if slot % per_shard:
            return
