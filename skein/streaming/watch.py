"""Change events of files in micro-batches: dedup, incremental upsert, and sessions."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.sources.store import ChunkStore

PAUSE = "500 milliseconds"


def changed_paths(events: DataFrame) -> DataFrame:
    """One row a path that was told of: a rename tells both names."""
    both = F.array_compact(F.array("path", F.col("old_path") if "old_path" in events.columns else F.lit(None).cast("string")))
    return events.select(F.explode(both).alias("path")).distinct()


def micro_batches(events: DataFrame, pause: str = PAUSE) -> DataFrame:
    """Distinct paths in each pause; on a stream with a watermark this is a windowed count."""
    return events.groupBy(F.window("ts", pause)).agg(F.approx_count_distinct("path").alias("paths") if events.isStreaming else F.count_distinct("path").alias("paths"), F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "paths", "events")


def sessions(events: DataFrame, gap: str = PAUSE) -> DataFrame:
    """Runs of events of a path with no pause longer than the gap: each is one change (a true debounce)."""
    return events.groupBy("path", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events")).select("path", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def debounced(events: DataFrame, gap: str = PAUSE, late: str = PAUSE) -> DataFrame:
    """The same on a stream, whatever micro-batches the events come in: a session is told once, when the watermark (the
    latest event less late) has passed its end. State is kept of open sessions alone; an event that is later is dropped."""
    return sessions(events.withWatermark("ts", late), gap)


def apply_batch(paths: DataFrame, store: ChunkStore, read: Callable[[DataFrame], DataFrame], project_id: int, number: int | None = None, delete_vanished: bool = False, compact: int = 8) -> None:
    """Changes the stored chunks of one project by a batch of paths. read turns paths into chunks; paths that it can't read
    are passed over, or, as an extension, their chunks go. Only the paths' buckets are written; one that so many batches
    have changed is compacted."""
    fresh = read(paths)
    gone = None
    if delete_vanished:
        there = fresh.select(F.col("file_path").alias("path")).distinct()
        gone = paths.join(there, "path", "left_anti").select(F.lit(project_id).alias("project_id"), F.col("path").alias("file_path"))
    store.write(fresh, gone, number)
    store.compact(compact)


def watch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, pause: str = PAUSE, once: bool = False) -> StreamingQuery:
    """Runs handle on each micro-batch's distinct paths; a batch that fails is logged and passed over, and its paths are
    added to the table <checkpoint>-failed, from which they can be told again."""

    def safe(batch: DataFrame, number: int) -> None:
        try:
            handle(changed_paths(batch), number)
        except Exception:
            logging.getLogger(__name__).exception("batch %d was passed over", number)
            changed_paths(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{checkpoint}-failed")

    writer = events.writeStream.foreachBatch(safe).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=pause)).start()
