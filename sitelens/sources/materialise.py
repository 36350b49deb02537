"""Cutting lineage in loops: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is sent to all executors up to so many rows.
MOST_SENT = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in a local session without it, as in tests."""
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


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for df in tables:
        jvm, hadoop = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/loop-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(hadoop).delete(path, True)


def sized(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A side of a join: sent to all executors if it is counted to have few rows, else left to Spark, which then splits the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
