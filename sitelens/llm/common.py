"""Reading tables, cutting lineage and joining links into components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks

#: Rows are handed to Python in batches of about so many bytes.
ARROW_BYTES = 4 << 20
WORK = "sitelens-"
#: Shuffle partitions that a task of a compact table takes, unless there are cores for more tasks.
COMPACT = 32
#: Has Spark drop the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; also bounds the bytes of an Arrow batch, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only in a local session without it."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        have = held.get() if held.isDefined() else None
    if not have:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(have)
    return have.rstrip("/")


def written(df: DataFrame, compact: bool = False, codec: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read back, so lost executors cost nothing done so far.

    The shuffle files of the plan that was written are dropped with it, so a loop doesn't fill the disks.  compact: for
    tables of few columns that come from a shuffle (not from a scan, which would be read by few tasks), which go to one task a core or COMPACT partitions; each task makes a file, and creating files
    costs more than such rows do.
    """
    spark = df.sparkSession
    if compact:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // COMPACT))
    path = f"{shared_dir(spark)}/{WORK}{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map function whose worker gives its memory back when the task ends: workers are kept and serve other operators."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Frees cached tables and the unused memory of the allocators."""
    textblocks.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again."""
    jvm, hadoop = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{WORK}" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def fresh_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its case."""
    have, out = {c.lower() for c in taken}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo a number of folds; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """Connected components of undirected edges: rows (id, component = smallest id reachable).

    Each round every node takes the smallest label among itself and its neighbours, then the label of
    that label (pointer jumping); both are joins and partial aggregates, so a node with very many
    edges is split by map-side aggregation.  Stops when no label changes.  An empty input gives no rows.
    """
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("to")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("to")))
    both = written(both.filter(F.col("id") != F.col("to")).distinct(), True)
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")), True)
    if labels.isEmpty():
        discard(both)
        return labels
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("id").alias("to"), "component"), "to")
            .groupBy("id")
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "id", "left").select(
            "id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was")
        )
        # hook: the old label learns the new one too, so whole trees move in a round
        hooks = lower.groupBy(F.col("was").alias("id")).agg(F.min("component").alias("root"))
        jumped = (
            lower.join(hooks.select(F.col("id").alias("component"), "root"), "component", "left")
            .select("id", F.least("component", F.coalesce("root", "component")).alias("component"), "was")
        )
        jumped = written(jumped, True)
        discard(labels)
        labels = jumped.select("id", "component")
        if jumped.filter(F.col("component") != F.col("was")).isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
