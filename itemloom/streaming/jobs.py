"""Continuous versions of the load, duplicate, status and metric jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.loads import stable_id

LATE = "1 hour"


def start_ingest(batch: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows under their stable id; a retried or repeated row is written once.

    Each micro-batch keeps one row per id, drops ids the table holds, and writes to the
    folder of its own batch number, so replaying a batch replaces its own output.
    """
    def write(df, n):
        spark = df.sparkSession
        keyed = df.withColumn("id", stable_id(F.col("scope"), F.col("idx"))).dropDuplicates(["id"])
        try:
            old = spark.read.parquet(path).filter(F.col("batch") != n).select("id")
            keyed = keyed.join(old, "id", "left_anti")
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        keyed.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return batch.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_in_window(stream: DataFrame, key: str = "fingerprint", at: str = "ts", late: str = LATE) -> DataFrame:
    """First row per key among rows less than ``late`` apart; state is dropped past the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def latest_state(stream: DataFrame) -> DataFrame:
    """Newest status per task (update mode); ties go to the higher event number."""
    return stream.groupBy("task").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def window_counts(stream: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Events per tumbling window and kind, emitted once the window can change no more."""
    return (stream.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("events"))
            .select(F.col("window.start").alias("start"), "status", "events"))


def stale_tasks(stream: DataFrame, quiet: str = "6 hours", late: str = LATE) -> DataFrame:
    """A task that stays in a running state for ``quiet`` of event time is reported once.

    The state per task is its last status and time; tasks that end drop their state.
    """
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            status, last = state.get
            state.remove()
            yield pd.DataFrame({"task": [key[0]], "status": [status], "last_ms": [last]})
            return
        status, last = state.get if state.exists else (None, -1)
        for pdf in frames:
            newest = pdf.sort_values(["ms", "event_id"]).iloc[-1]
            if int(newest["ms"]) >= last:
                status, last = str(newest["status"]), int(newest["ms"])
        if status in ("done", "error"):
            if state.exists:
                state.remove()
            return
        state.update((status, last))
        state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))

    timed = stream.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("task").applyInPandasWithState(
        step, "task long, status string, last_ms long", "status string, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop; update output keeps the newest row per batch folder."""
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        def write(batch, n):
            batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
