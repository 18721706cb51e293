"""Streams over the append-only event log: windows, sessions, deduplication, stateful totals, per-batch hooks.

Each transformation takes and returns a DataFrame, streaming or not, so a batch run gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillframe.scratch import scratch_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``events*.parquet``; event time as a timestamp, as watermarks want it."""
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Tumbling, or with ``slide`` sliding windows: events, value and users by type."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "2 days") -> DataFrame:
    """A user's events without a pause of ``gap`` or more."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def first_of_key(events: DataFrame, key: list[str], late: str = "2 days") -> DataFrame:
    """Drops repeats of a key as long as the watermark remembers it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def running_totals(events: DataFrame, idle_ms: int = 30 * 86_400_000, late: str = "2 days") -> DataFrame:
    """(user_id, n, total) after each batch; a user whose last event lies ``idle_ms`` behind the watermark is forgotten."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
            last = max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 6)]})

    timed = events.withWatermark("ts", late).select("user_id", "ts", "value")
    return timed.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str, each_batch: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame:
    """Runs what is there and stops; the result is what the last batch (complete) or all batches (append, update) gave.

    Offsets, state and results lie in ``folder``; a run with the folder of an earlier one goes on where that stopped.  Without
    one the run has a new folder in the shared scratch folder."""
    spark = stream.sparkSession
    folder = folder or f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        if each_batch:
            each_batch(batch, number)
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == (out.agg(F.max("batch")).first()[0] or 0))
    return out if mode == "update" else out.drop("batch")
