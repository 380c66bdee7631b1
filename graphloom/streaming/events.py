"""File events: classification, debounce and bounded batches that lose nothing, for tables of events and for streams.

Tables are debounced by session windows over the events' own times. The watcher's stream keeps state by path and timers instead
(``debounce``): it waits until a path is quiet, as the single-node tool does, and caps its batches itself."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from graphloom.functions import language
from graphloom.schema import EVENTS
from graphloom.streaming import debounce


def classify(event_type: Column) -> Column:
    """Modified, Created or Removed; null for events that change nothing."""
    return F.when(event_type.isin("modify_name", "modify_data", "modify_any"), "Modified").when(event_type == "create", "Created").when(event_type == "remove", "Removed")


def relevant(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Classified events of supported files outside ignored directories."""
    typed = events.withColumn("event_type", classify(F.col("event_type"))).where("event_type is not null")
    return typed.where(language.language_of(F.col("path")).isNotNull() & F.contains("path", F.lit(".")) & ~language.ignored(F.col("path"), extra))


def debounced(events: DataFrame, gap: str = "200 milliseconds", watermark: str | None = None) -> DataFrame:
    """(path, started, released, n, last_type): one row a burst of events of a path that are less than ``gap`` apart.

    Works on a batch or, with a watermark, on a stream."""
    source = events.withWatermark("ts", watermark) if watermark else events
    bursts = source.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_type")).alias("last_type"))
    # sessions merge only beside an aggregate, so the ends read the count: pruning must not take it away
    end = lambda c: F.when(F.col("n") > 0, F.col(f"w.{c}"))
    return bursts.select("path", end("start").alias("started"), end("end").alias("released"), "n", "last_type")


def batches(released: DataFrame, seconds: int = 60, most: int = 50) -> DataFrame:
    """(tick, batch, path): distinct paths of each tick, sorted, in batches of at most ``most``; what is over goes to the next batch."""
    at = F.unix_seconds(F.col("released").cast("timestamp"))
    ticked = released.select(F.timestamp_seconds(at - F.pmod(at, F.lit(seconds))).alias("tick"), "path").distinct()
    place = F.row_number().over(Window.partitionBy("tick").orderBy("path"))
    return ticked.withColumn("batch", F.floor((place - 1) / most).cast("int"))


def actions(events: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, action) a path by its last event: delete what was removed, skip what is missing, index the rest."""
    last = events.groupBy("path").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("event_type"))
    there = disk.select("path", F.lit(True).alias("there"))
    return last.join(there, "path", "left").select("path", F.when(F.col("event_type") == "Removed", "delete").when(F.col("there"), "index").otherwise("skip").alias("action"))


class Watcher:
    """Runs a stream of file events through filter, debounce and capped batches, and hands the paths of each batch to ``process`` (path, last_type).

    ``source`` is a folder of JSON events or a streaming frame of (path, ts, event_type), such as ``scan.changes``. A batch whose ``process`` fails
    ends the query; a start from the same checkpoint gives it the same paths again."""

    def __init__(self, spark: SparkSession, source: str | DataFrame, checkpoint: str, process: Callable[[DataFrame], None], gap_ms: int = 200, most: int = 50, lanes: int = 1, files_per_trigger: int = 50) -> None:
        self.spark, self.source, self.checkpoint, self.process = spark, source, checkpoint, process
        self.gap_ms, self.most, self.lanes, self.files_per_trigger = gap_ms, most, lanes, files_per_trigger
        self.processed, self.query, self._busy = 0, None, False

    @property
    def state(self) -> str:
        """By what the query says: Idle, Dirty (something waits), Parsing (a batch is being processed), Recover (it failed), Shutdown."""
        if self.query is None:
            return "Idle"
        if not self.query.isActive:
            return "Recover" if self.query.exception() else "Shutdown"
        return "Parsing" if self._busy else "Dirty" if debounce.pending(self.query) else "Idle"

    def _batch_id(self) -> int:
        held = self.query.lastProgress
        return held["batchId"] if held else -1

    def _batch(self, df: DataFrame, _epoch: int) -> None:
        rows = df.select("path", "last_type").collect()  # most * lanes at most, taken once, as each look runs the timers again
        if rows:
            self._busy = True
            try:
                self.process(self.spark.createDataFrame(sorted(rows), "path string, last_type string"))
                self.processed += len(rows)
            finally:
                self._busy = False

    def start(self, interval: str = "1 second") -> StreamingQuery:
        events = self.source if isinstance(self.source, DataFrame) else self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", self.files_per_trigger).json(self.source)
        batches_ = debounce.capped(debounce.debounce(relevant(events), self.gap_ms), self.most, self.lanes)
        with debounce.rocks(self.spark):
            self.query = batches_.writeStream.outputMode("append").option("checkpointLocation", self.checkpoint).trigger(processingTime=interval).foreachBatch(self._batch).start()
        return self.query

    def stop(self, drain_seconds: float = 60.0) -> None:
        """Ends the query once all that has arrived is read, released and processed, or after ``drain_seconds``; what waits then stays in the checkpoint."""
        if self.query is not None and self.query.isActive:
            until, begun = time.time() + drain_seconds, self._batch_id()
            # a micro-batch that began after this call has read what had arrived; this kind of query always has a next one, so waiting for all that is available would not end
            while self.query.isActive and time.time() < until and (self._batch_id() < begun + 2 or self.query.lastProgress["numInputRows"] or debounce.pending(self.query) or self._busy):
                time.sleep(0.05)
            while self.query.isActive and time.time() < until and self.query.status["isTriggerActive"]:
                time.sleep(0.01)  # between two micro-batches, so that none is cut off
            self.query.stop()
