"""Streams of events: windows, sessions, dedupe with a watermark, incremental snapshots. Each function takes a streaming or
a batch frame and returns one; sinks are the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 10) -> DataFrame:
    """New Parquet files of a folder, with a timestamp that has a zone."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, *, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum by type and window; rows later than the watermark are left out of a stream."""
    over = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(over.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events with no gap above the limit."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


class OpenSessions(StatefulProcessor):
    """Sessions of one user that can still grow, as state: a micro-batch touches the users that it has rows of, and those whose
    timers are due. A session is given out, and leaves the state, when the watermark has passed its last event by the gap."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [tuple(s) for s in self.open.get()]
        for f in rows:
            at = f["ts"].astype("datetime64[us]").astype("int64")
            found += [(int(t), int(t), 1, float(v)) for t, v in zip(at, f["value"], strict=True)]
        merged: list[tuple] = []
        for start, last, n, total in sorted(found):
            if merged and start - merged[-1][1] < self.gap:
                a, z, m, sums = merged[-1]
                merged[-1] = (a, max(z, last), m + n, sums + total)
            else:
                merged.append((start, last, n, total))
        self._kept(merged)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        found = [tuple(s) for s in self.open.get()]
        done = [s for s in found if s[1] + self.gap <= now]
        self._kept([s for s in found if s[1] + self.gap > now])
        if done:
            yield pd.DataFrame([(key[0], pd.Timestamp(s[0], unit="us"), s[2], s[3]) for s in done], columns=["user_id", "start", "n", "total"])

    def _kept(self, found: list[tuple]) -> None:
        if found:
            self.open.put(found)
        else:
            self.open.clear()
        wanted = {-(-(last + self.gap) // 1000) for _, last, _, _ in found}
        held = set(self.handle.listTimers())
        for t in held - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - held:
            self.handle.registerTimer(t)

    def close(self) -> None:
        pass


def session_state(events: DataFrame, *, gap_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """The sessions of a stream of ``user_id, ts, value``, each once and when it is over; a state by user with timers. Equal to
    ``sessions`` in append mode. Needs a state store with column families (``spark.sql.streaming.stateStore.providerClass``
    set to the RocksDB provider)."""
    rows = events.withWatermark("ts", late).groupBy("user_id")
    return rows.transformWithStateInPandas(OpenSessions(gap_minutes * 60_000), "user_id long, start timestamp, n long, total double", "Append", "EventTime")


def once(events: DataFrame, *, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to ``write(batch, number)``; a number comes again only after a failure."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revisions(stream: DataFrame, table: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest row of each key (by ``order``) of a stream in a Parquet table of versions, one for each micro-batch; an
    earlier row that comes late changes nothing. ``current`` reads the newest."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = current(spark, table)
        both = batch if held is None else held.unionByName(batch)
        latest = both.groupBy(*key).agg(F.max_by(F.struct(*[c for c in both.columns if c not in key]), F.col(order)).alias("r")).select(*key, "r.*")
        # a repeated number, after a failure, writes the same version again
        latest.select(*both.columns).write.mode("overwrite").parquet(f"{table}/version={number:09d}")

    return to_batches(stream, write, checkpoint)


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest complete version of a table of versions; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    done = [n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{table}/{done[-1]}") if done else None


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds a stream's rows to a log that is never rewritten, each once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
