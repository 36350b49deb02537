"""Job and fetch feeds as streams, each with a batch twin.

Streams take a DataFrame from readStream and return one to start; `drained` runs one over all that is there now and gives
the written result.  State is bounded by the number of jobs or domains, or by a watermark.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.scoring import analyse_pages
from ..sources.materialise import shared_folder, sized

STAGES = (("init", 0, 10), ("crawl", 10, 40), ("analyse", 40, 80), ("merge", 80, 90), ("done", 90, 101))
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a slice of a domain's time, about, where windows are cut.
SLICE_ROWS = 100_000
#: Buckets of keys that the hourly dedupe keeps its state by.
DEDUPE_BUCKETS = 2048


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, with the table's own schema.  A pattern as path takes one file as well as a folder of parts."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(stream: DataFrame, mode: str, base: str, write: Callable[[DataFrame, int], None], trigger: dict | None) -> None:
    """Runs a stream over what is there now; its state is kept by RocksDB, which state variables and timers ask for."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state")
        query.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def drained(stream: DataFrame, mode: str, trigger: dict | None = None, base: str | None = None) -> DataFrame:
    """Run a stream over what is there now; the rows of its last state (complete) or all of them (append), as a table.

    base: a folder to go on from, if a stream was drained into it before; each batch has a folder of its own, so that one that
    runs again leaves the same rows.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    _run(stream, mode, base, write, trigger)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{base}/out")
    whole = schema.jsonValue()
    whole["fields"].append({"name": "batch", "type": "long", "nullable": True, "metadata": {}})
    return spark.read.schema(StructType.fromJson(whole)).option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch")


class KeyedTable:
    """A table of the latest row of each key, in files: changed rows by batch, and from time to time all rows.

    `changes-<n>` has the rows that batch n changed, `base-<n>` all rows after batch n.  A reader takes the newest whole base and the
    changes since.  A batch that runs again overwrites its own folder with the same rows, so nothing changes.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], every: int = 16):
        self.spark, self.folder, self.schema, self.keys, self.every = spark, folder, schema, keys, every

    def _numbers(self, kind: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        inside = lambda n: self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS")
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-") and files.exists(inside(n)))

    def put(self, batch: DataFrame, number: int) -> None:
        """The rows of batch `number`, one for each key that it changed."""
        batch.write.mode("overwrite").parquet(f"{self.folder}/changes-{number}")
        bases = self._numbers("base")
        if number - max(bases, default=-1) >= self.every:
            self.rows().write.mode("overwrite").parquet(f"{self.folder}/base-{number}")

    def changed(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/changes-{number}")

    def rows(self) -> DataFrame:
        """The latest row of each key."""
        base = max(self._numbers("base"), default=-1)
        parts = [self.changed(n).withColumn("__n", F.lit(n)) for n in self._numbers("changes") if n > base]
        if base >= 0:
            parts.append(self.spark.read.schema(self.schema).parquet(f"{self.folder}/base-{base}").withColumn("__n", F.lit(base)))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rest = [c for c in self.schema.names if c not in self.keys]
        latest = functools.reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "__n").alias("row"))
        return latest.select(*self.keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*self.schema.names)


def upserted(stream: DataFrame, keys: list[str], trigger: dict | None = None, base: str | None = None) -> KeyedTable:
    """Run a stream of aggregates by key in update mode: each batch brings only the keys it changed, which are merged by batch number."""
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{base}/table", stream.schema, keys)
    _run(stream, "update", base, table.put, trigger)
    return table


def job_state(events: DataFrame) -> DataFrame:
    """The latest status, progress and step of each job by (time, event)."""
    latest = F.max_by(F.struct("status", "progress", "event_id"), F.struct("ts", "event_id")).alias("latest")
    out = events.groupBy("job_id").agg(latest, F.count("*").alias("n_events"))
    return out.select("job_id", "latest.status", "latest.progress", stage_of(F.col("latest.progress")).alias("step"), "latest.event_id", "n_events")


def allowed(action: Column, status: Column) -> Column:
    """Cancel unless completed or failed; retry only from failed."""
    return F.when(action == "cancel", ~F.coalesce(status.isin("completed", "failed"), F.lit(False))).when(action == "retry", F.coalesce(status == "failed", F.lit(False))).otherwise(F.lit(True))


def lifecycle(events: DataFrame) -> DataFrame:
    """Each event with the status before it and whether a cancel or retry would have been allowed then."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    return events.withColumn("before", before).select("job_id", "event_id", "status", "before", allowed(F.lit("cancel"), F.col("before")).alias("may_cancel"), allowed(F.lit("retry"), F.col("before")).alias("may_retry"))


class _InOrder(StatefulProcessor):
    """A processor that takes the rows of a key in order of (ts, event_id) within a batch.

    A batch's rows of one key are held while they are sorted; maxFilesPerTrigger of the source bounds them.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.begin()

    def begin(self) -> None: ...

    def close(self) -> None: ...

    @staticmethod
    def ordered(rows: Iterator[Row]) -> list[Row]:
        return sorted(rows, key=lambda r: (r.ts, r.event_id))


class Lifecycle(_InOrder):
    """State of a job: its last status."""

    def begin(self) -> None:
        self.status = self.handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self.status.get()[0] if self.status.exists() else None
        for r in self.ordered(rows):
            yield Row(job_id=key[0], event_id=r.event_id, status=r.status, before=before, may_cancel=before not in ("completed", "failed"), may_retry=before == "failed")
            before = r.status
        self.status.update((before,))


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """The same on a stream: the state of a job is its last status."""
    out = "job_id long, event_id long, status string, before string, may_cancel boolean, may_retry boolean"
    return events.select("job_id", "event_id", "ts", "status").groupBy("job_id").transformWithState(Lifecycle(), out, "append", "None")


def stage_of(progress: Column) -> Column:
    out = F.lit("unknown")
    for name, low, high in reversed(STAGES):
        out = F.when((progress >= low) & (progress < high), name).otherwise(out)
    return out


def stage_progress(events: DataFrame) -> DataFrame:
    """Furthest progress and stage of each job (events: job_id, progress 0 to 100)."""
    return events.groupBy("job_id").agg(F.max("progress").alias("progress")).withColumn("stage", stage_of(F.col("progress")))


def sliced(events: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """events with micros and `slice`, the place of their slice of time: slices have some `rows` rows if events are spread evenly."""
    at = events.withColumn("micros", F.unix_micros("ts"))
    span = at.agg(F.min("micros").alias("low"), F.max("micros").alias("high"), F.count("*").alias("n")).first()
    if not span["n"]:
        return at.withColumn("slice", F.lit(0).cast("long"))
    width = max(1_000_000, (span["high"] - span["low"]) * rows // span["n"] + 1)
    return at.withColumn("slice", F.floor((F.col("micros") - F.lit(span["low"])) / F.lit(width)))


def rate_audit(events: DataFrame, rates: DataFrame, default_rate: float = 1.0, burst: int = 3, rows: int = SLICE_ROWS) -> DataFrame:
    """Requests with a gap below 1 / rate of their domain, the delay they needed, and those over the burst within a second.

    A domain's time is cut into slices, so that one busy domain is spread: the requests of the second before a slice go
    along as guests, for the count, and the time of the last request before it is joined, for the gap.
    """
    at = sliced(events.select("domain", "event_id", "ts"), rows)
    last = at.groupBy("domain", "slice").agg(F.max("micros").alias("last"))  # a row for each slice
    carried = last.select("domain", "slice", F.lag("last").over(Window.partitionBy("domain").orderBy("slice")).alias("before"), F.lead("slice").over(Window.partitionBy("domain").orderBy("slice")).alias("next"), "last")
    # slices are at least a second long, so the second before one lies in the slice before it
    first = at.groupBy("domain", "slice").agg(F.min("micros").alias("first")).select("domain", F.col("slice").alias("next"), "first")
    edge = carried.filter("next = slice + 1").select("domain", "slice", "next").join(first, ["domain", "next"])
    guests = at.join(edge, ["domain", "slice"]).filter(F.col("micros") >= F.col("first") - 1_000_000).select("domain", F.col("next").alias("slice"), "event_id", "micros", F.lit(True).alias("guest"))
    dealt = at.select("domain", "slice", "event_id", "micros", F.lit(False).alias("guest")).unionByName(guests)
    within = Window.partitionBy("domain", "slice")
    order = within.orderBy("micros", "event_id")
    looked = dealt.withColumns({"previous": F.lag("micros").over(order), "in_second": F.count("*").over(within.orderBy("micros").rangeBetween(-1_000_000, 0))}).filter(~F.col("guest"))
    looked = looked.join(carried.select("domain", "slice", "before"), ["domain", "slice"]).withColumn("gap", (F.col("micros") - F.coalesce("previous", "before")) / 1e6)
    least = 1 / F.coalesce("rate", F.lit(default_rate))
    return looked.join(sized(rates), "domain", "left").select("domain", "event_id", F.round("gap", 6).alias("gap"), F.round(F.greatest(least - F.col("gap"), F.lit(0.0)), 6).alias("delay"), (F.col("in_second") > burst).alias("over_burst"))


def rate_windows(events: DataFrame, burst: int = 0) -> DataFrame:
    """The streaming form: one-second windows with more requests than the burst; late data up to ten seconds.

    In append mode a window comes out once the watermark has passed it, and its state is then dropped.
    """
    return events.withWatermark("ts", "10 seconds").groupBy("domain", F.window("ts", "1 second")).agg(F.count("*").alias("n")).filter(F.col("n") > burst)


def moving_latency(events: DataFrame, n: int = 10, least: int = 5, rows: int = SLICE_ROWS) -> DataFrame:
    """The mean of each request's and the n - 1 latencies before it in its domain, once there are `least`.

    A domain's time is cut into slices; the last n - 1 rows before a slice go along with it as guests.
    """
    at = sliced(events.select("domain", "event_id", "ts", "latency"), rows)
    own = Window.partitionBy("domain", "slice")
    tails = at.withColumn("from_end", F.row_number().over(own.orderBy(F.desc("micros"), F.desc("event_id")))).filter(F.col("from_end") < n)
    row = F.struct("micros", "event_id", "latency")
    # before the first of a slice's last rows stand the last rows of earlier slices, n - 1 of which are all that it needs
    line = Window.partitionBy("domain").orderBy("micros", "event_id")
    ends = tails.withColumns({"before": F.collect_list(row).over(line.rowsBetween(1 - n, -1)), "slice_before": F.lag("slice").over(line)})
    firsts = ends.filter(F.col("slice_before").isNotNull() & (F.col("slice_before") != F.col("slice")))
    guests = firsts.select("domain", "slice", F.explode("before").alias("g")).select("domain", "slice", "g.*", F.lit(True).alias("guest"))
    dealt = at.select("domain", "slice", "micros", "event_id", "latency", F.lit(False).alias("guest")).unionByName(guests)
    w = own.orderBy("micros", "event_id").rowsBetween(1 - n, 0)
    looked = dealt.withColumn("average", F.when(F.count("*").over(w) >= least, F.round(F.avg("latency").over(w), 6))).filter(~F.col("guest"))
    return looked.select("domain", "event_id", "average")


def adapt(rate: float, latencies: list[float], errors: int, good: int, latency: float, ok: bool) -> tuple[float, list[float], int, int]:
    """One request's effect on (rate, last ten latencies, errors in a row, successes since the last increase); five requests come first."""
    latencies = [*latencies, latency][-10:]
    errors, good = (0, good + 1) if ok else (errors + 1, good)
    if len(latencies) < 5:
        return rate, latencies, errors, good
    mean = sum(latencies) / len(latencies)
    if errors >= 3:
        return max(0.1, rate * 0.8), latencies, 0, good
    if mean > 2.0:
        return max(0.1, rate * 0.8), latencies, errors, good
    if mean < 0.5 and good >= 5:
        return min(5.0, rate * 1.2), latencies, errors, 0
    return rate, latencies, errors, good


class AdaptiveRate(_InOrder):
    """State of a domain: its rate and counters, and a list of its last ten latencies."""

    def __init__(self, start: float):
        self.start = start

    def begin(self) -> None:
        self.counters = self.handle.getValueState("counters", "rate double, errors long, good long")
        self.latencies = self.handle.getListState("latencies", "latency double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        rate, errors, good = self.counters.get() if self.counters.exists() else (self.start, 0, 0)
        latencies = [x[0] for x in self.latencies.get()] if self.latencies.exists() else []
        for r in self.ordered(rows):
            rate, latencies, errors, good = adapt(rate, latencies, errors, good, r.latency, r.ok)
        self.counters.update((rate, errors, good))
        self.latencies.put([(x,) for x in latencies])
        yield Row(domain=key[0], rate=round(rate, 6), errors=errors)


def adaptive_rate_stream(events: DataFrame, start: float = 1.0) -> DataFrame:
    """The recommended rate of each domain after each batch; state is ten latencies and two counters for a domain."""
    rows = events.select("domain", "event_id", "ts", "latency", "ok")
    return rows.groupBy("domain").transformWithState(AdaptiveRate(start), "domain string, rate double, errors long", "append", "None")


def limiter_statistics(audited: DataFrame, events: DataFrame) -> DataFrame:
    """By domain: requests, delayed ones, total and mean delay, least, greatest and mean latency."""
    delays = audited.groupBy("domain").agg(F.count("*").alias("requests"), F.count_if(F.col("delay") > 0).alias("delayed"), F.round(F.sum(F.coalesce("delay", F.lit(0.0))), 4).alias("total_delay"))
    latency = events.groupBy("domain").agg(F.min("latency").alias("min_latency"), F.max("latency").alias("max_latency"), F.round(F.avg("latency"), 6).alias("avg_latency"))
    return delays.join(latency, "domain")


def request_key(*columns: str) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def dedupe_hour(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Batch twin of the hourly dedupe: an event stays when the last kept one of its key is at least an hour before.

    Keys are sorted within partitions and read as a stream, so a key with very many events is never gathered.
    """

    def run(batches):
        key_now, last = None, 0
        for batch in batches:
            kept = []
            for key, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist(), strict=True):
                take = key != key_now or t - last >= seconds * 1_000_000
                key_now, last = key, t if take else last
                kept.append(take)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept, pa.bool_())) for c in ("key", "event_id")], names=["key", "event_id"])

    rows = events.select(request_key("job_id", "status").alias("key"), F.unix_micros("ts").alias("t"), "event_id")
    return rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInArrow(run, "key string, event_id long")


class DedupeHour(StatefulProcessor):
    """State of a bucket of keys: the times of their last kept events in one value, read and written once a batch.

    A time that can refuse nothing any more is dropped when its bucket has rows, or by the bucket's one timer.
    """

    ENTRY = np.dtype([("key", "S16"), ("last", "<i8")])

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "entries binary")

    def close(self) -> None: ...

    def _held(self) -> np.ndarray | None:
        """The entries; None without a state, and so without a timer."""
        return np.frombuffer(bytes(self.state.get()[0]), dtype=self.ENTRY) if self.state.exists() else None

    def _open(self, entries: np.ndarray, watermark: int) -> np.ndarray:
        return entries[self._ends(entries) > watermark]

    def _ends(self, entries: np.ndarray) -> np.ndarray:
        return (entries["last"] + self.micros) // 1000

    def _remember(self, entries: np.ndarray, watermark: int) -> None:
        self.state.update((entries.tobytes(),))
        self.handle.registerTimer(max(int(self._ends(entries).max()), watermark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["key", "micros", "event_id"])
        held, watermark = self._held(), timerValues.getCurrentWatermarkInMs()
        known = [] if held is None else zip(held["key"].tolist(), held["last"].tolist(), strict=True)
        last = {k.ljust(16, b"\0"): t for k, t in known}  # numpy leaves out zero bytes at the end
        kept, key_now, raw = [], None, b""
        for name, t in zip(batch["key"].tolist(), batch["micros"].tolist(), strict=True):
            if name != key_now:
                key_now, raw = name, bytes.fromhex(name)
            before = last.get(raw)
            take = before is None or t - before >= self.micros
            if take:
                last[raw] = t
            kept.append(take)
        entries = np.fromiter(last.items(), dtype=self.ENTRY, count=len(last))
        if held is None:
            self._remember(entries, watermark)
        else:  # the bucket's timer is still to come
            self.state.update((self._open(entries, watermark).tobytes(),))
        yield batch.loc[np.array(kept), ["key", "event_id"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        entries = self._open(self._held(), watermark)  # a bucket with a timer has a state
        if len(entries):
            self._remember(entries, watermark)
        else:
            self.state.clear()
        return iter([])


def dedupe_hour_stream(events: DataFrame, seconds: int = 3600, buckets: int = DEDUPE_BUCKETS) -> DataFrame:
    """The same on a stream: the state of a key is the time of its last kept event, dropped once the watermark is an hour past it.

    Keys are dealt into buckets, as each state call is a way to the JVM and back.  A bucket's rows of a batch are held while they are
    sorted; maxFilesPerTrigger bounds them.  The number of buckets holds for a checkpoint's life.
    """
    keyed = events.withColumns({"key": request_key("job_id", "status"), "micros": F.unix_micros("ts")}).select("key", "event_id", "micros", "ts").withWatermark("ts", "10 seconds")
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(DedupeHour(seconds), "key string, event_id long", "append", "EventTime")


def analyse_stream(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """Verdicts of each page as it arrives: a stream joined with the keyword dimension."""
    return analyse_pages(pages, keywords)


def discovery_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count("*").alias("n"))
