"""Structured Streaming forms of the job tables: progress, states, metrics, logs, page files.

Event times of the tables have no zone; they are cast to timestamps before a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from quirefold.functions.bins import percent
from quirefold.operators import jobs
from quirefold.operators.jobs import STATES

#: How late an event may be, and for how long a repeated one is recognised.
WATERMARK = "1 hour"
#: Items whose last events are one row of a job's state.
BLOCK = 256
STORE = "spark.sql.streaming.stateStore.providerClass"
LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])


def latest_progress(events: DataFrame) -> DataFrame:
    """As the batch form, on a stream in update mode; repeated events within the watermark count once."""
    last = F.max_by(F.struct("phase", "done", "total"), F.struct("ts", "event_id")).alias("p")
    out = _timed(events).groupBy("job_id").agg(last)
    return out.select("job_id", "p.phase", "p.done", "p.total", percent(F.col("p.done"), F.col("p.total")).alias("pct"))


def latest_items(events: DataFrame) -> DataFrame:
    """The last state of every (job_id, item)."""
    last = F.max_by(F.struct("done", "total", "status"), F.struct("ts", "event_id")).alias("p")
    return _timed(events).groupBy("job_id", "item").agg(last).select("job_id", "item", "p.*")


def regroup(scalars: DataFrame) -> DataFrame:
    """Stateless; the batch operator as it is."""
    return jobs.regroup(scalars)


def online_eval(values: DataFrame) -> DataFrame:
    """(epoch, metric, bin, value) -> running n, mean and population deviation of each group, in update mode."""
    g = values.groupBy("epoch", "metric", "bin").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / F.col("n")
    return g.select("epoch", "metric", "bin", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"))


def _next_states() -> dict[str | None, set[str]]:
    after: dict[str | None, set[str]] = {None: {STATES[0]}, "error": {"error"}}
    for i, s in enumerate(STATES):
        after[s] = {s, "error", *STATES[i + 1 : i + 2]}
    return after


class _Transitions(StatefulProcessor):
    """Takes a job's events in order of (ts, event_id), each once the watermark has passed it."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms, self.after = expire_ms, _next_states()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, event_id long, status string")
        self.pending = handle.getListState("pending", "ts long, event_id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()
        new = [at for part in rows for at in zip(part["ts_us"].tolist(), part["event_id"].tolist(), part["status"].tolist(), strict=True)]
        new = [at for at in new if last is None or at[:2] > tuple(last[:2])]  # else it is there already
        if new:
            self.pending.appendList(new)
            self._wake(min(at[0] for at in new))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = sorted({tuple(x[:2]): x[2] for x in self.pending.get()}.items())
        ready = [x for x in waiting if x[0][0] // 1000 < now]
        last = self.last.get()
        last = tuple(last) if last is not None else None
        for at, status in ready:
            prev = last[2] if last else None
            if status not in self.after.get(prev, {"error"}):
                out.append((key[0], at[1], prev, status))
            last = (*at, status)
        if ready:
            self.last.update(last)
            if len(ready) < len(waiting):
                self.pending.put([(*at, status) for at, status in waiting[len(ready) :]])
            else:
                self.pending.clear()
        if len(ready) < len(waiting):
            self._wake(waiting[len(ready)][0][0])
        elif self.expire_ms is not None and last:
            if last[0] // 1000 + self.expire_ms < now:
                self.last.clear()
            else:
                self._wake(last[0] + 1000 * self.expire_ms)
        yield pd.DataFrame(out, columns=["job_id", "event_id", "prev", "cur"]) if out else pd.DataFrame()

    def _wake(self, ts_us: int) -> None:
        self.handle.registerTimer(ts_us // 1000 + 1)


def invalid_transitions(status: DataFrame, delay: str = WATERMARK, expire_ms: int | None = None) -> DataFrame:
    """(job_id, ts, event_id, status) stream -> job_id, event_id, prev, cur of transitions that a job may not make.

    Events of a job wait in a list, which moves to Python and back whole, until the watermark, ``delay`` behind the newest event, has passed them, and are then
    taken in order of (ts, event_id); so the order in which they come doesn't matter within it, and one that comes again changes
    nothing. Later ones are dropped. A job without events for ``expire_ms`` is forgotten: its next event is a first one. None keeps the
    last status of every job. Appends. Needs the session's state store to be RocksDB (``state_store``).
    """
    ts = F.col("ts").cast("timestamp")
    rows = status.select("job_id", ts.alias("ts"), F.unix_micros(ts).alias("ts_us"), "event_id", "status")
    schema = "job_id long, event_id long, prev string, cur string"
    return rows.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(_Transitions(expire_ms), schema, "Append", "EventTime")


class _Patches(StatefulProcessor):
    """The last event of each item of a job, and its figures. Items lie in blocks of neighbours, each of which is one row of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", "item array<long>, ts array<long>, event_id array<long>, finished array<boolean>, failed array<boolean>")
        self.sums = handle.getValueState("sums", "items long, finished long, failed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest: dict[int, dict[int, tuple]] = {}
        for part in rows:
            for item, *event in zip(*[part[c].tolist() for c in ("item", "ts_us", "event_id", "finished", "failed")], strict=True):
                of = newest.setdefault(item // BLOCK, {})
                of[item] = max(of.get(item, tuple(event)), tuple(event))
        items, finished, failed = self.sums.get() or (0, 0, 0)
        for block, of in newest.items():
            kept = self.blocks.getValue((block,))
            held = {i: tuple(event) for i, *event in zip(*kept, strict=True)} if kept else {}
            for item, event in of.items():
                old = held.get(item)
                if old is None or event[:2] > old[:2]:
                    items += old is None
                    finished += event[2] - (old[2] if old else 0)
                    failed += event[3] - (old[3] if old else 0)
                    held[item] = event
            self.blocks.updateValue((block,), ([*held], *[list(c) for c in zip(*held.values(), strict=True)]))
        self.sums.update((items, finished, failed))
        yield pd.DataFrame([(key[0], items, finished, failed)], columns=["job_id", "items", "finished", "failed"])


def patch_progress(events: DataFrame) -> DataFrame:
    """(job_id, item, ts, event_id, done, total, status) stream -> job_id, items, finished, failed, pct of every job that had an event, in update mode.

    A job's state is the last event of each of its items, so late and repeated events change nothing that they shouldn't.
    Needs the session's state store to be RocksDB (``state_store``).
    """
    ts, status = F.col("ts").cast("timestamp"), F.coalesce(F.col("status") == "error", F.lit(False))
    done = F.coalesce(F.col("done") >= F.col("total"), F.lit(False))
    rows = events.select("job_id", F.col("item").cast("long").alias("item"), F.unix_micros(ts).alias("ts_us"), "event_id", done.alias("finished"), status.alias("failed"))
    out = rows.groupBy("job_id").transformWithStateInPandas(_Patches(), "job_id long, items long, finished long, failed long", "Update", "None")
    return out.withColumn("pct", percent(F.col("finished"), F.col("items")))


def upsert(path: str):
    """A foreachBatch function that keeps every batch's rows in a folder of its own; a batch that is run again replaces its rows."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def latest(spark: SparkSession, path: str, schema, *keys: str) -> DataFrame:
    """Of each key the row of the newest batch that ``upsert`` has kept."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("p")).select(*keys, "p.*")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def state_store(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB."""
    return _setting(spark, STORE, ROCKS)


def listing(spark: SparkSession):
    """Queries that are started inside look up the files of a batch in a task a core, not in a task a file."""
    return _setting(spark, LISTERS, str(spark.sparkContext.defaultParallelism))


def ingest(spark: SparkSession, path: str, pattern: str = "*.png", per_trigger: int = 1000) -> DataFrame:
    """A stream of new page files (path, modified, length), each once; many are best started inside ``listing``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now and returns its table; for tests and reports of bounded size."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
