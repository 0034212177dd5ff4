"""Structured Streaming jobs (R1-R3) over a log stream.

R1 replaces the reference's in-process queue and flush timer: a file or
Kafka source, the level threshold and enrichment as column expressions,
micro-batches every few seconds into the day-partitioned table, exactly
once by checkpoint (back-pressure instead of dropped rows).

R2 keeps running cluster totals in the state store and publishes the
clusters that a micro-batch changed under its number; every few batches the
changes are folded into a snapshot and old versions deleted. A batch
replayed after a failure finds its version already written and skips it.

R3 clusters per event-time window; the watermark drops rows later than it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorlens.functions.fingerprints import cluster_id, fingerprint
from errorlens.functions.levels import at_least, is_error, normalize_level
from errorlens.functions.templates import normalize_message
from errorlens.functions.traces import class_of_head_line, exception_head_line
from errorlens.operators.clusters import severity
from errorlens.operators.filters import enrich_location, enrich_trace_id
from errorlens.operators.state import write_changes
from errorlens.sources.logs import with_ingest_defaults


def ingest_stream(stream: DataFrame, sink_path: str, checkpoint: str, threshold: str = "WARN",
                  trigger: str | None = "5 seconds", available_now: bool = False):
    """Keep rows whose level, normalised, is at or above ``threshold``, fill ``trace_id`` from the
    context and a missing location from the trace, apply store defaults and append to the day-partitioned table."""
    rows = stream.filter(at_least(normalize_level("level"), threshold))
    if "mdc_context" in rows.columns:
        rows = enrich_trace_id(rows)
    rows = enrich_location(rows, "first_user")
    rows = with_ingest_defaults(rows)
    w = (rows.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).partitionBy("log_date").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def _cluster_totals(mode: str) -> list[Column]:
    """The aggregates of a cluster over its error rows: count, seen range, and
    message, head line of the trace and location of the newest row that has them."""
    order = F.struct("timestamp", "id")
    line, loc = F.col("_head"), F.col("_loc")
    with_line = order if mode == "cloud" else F.when(line.isNotNull(), order)
    with_loc = order if mode == "cloud" else F.when(F.col("_loc.file_name").isNotNull(), order)
    return [F.count(F.lit(1)).alias("occurrence_count"), F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"), F.max_by("message", order).alias("_message"),
            F.max_by(line, with_line).alias("_head"), F.max_by(loc, with_loc).alias("_loc")]


def _cluster_rows(stream: DataFrame, mode: str, *more: str) -> DataFrame:
    return stream.filter(is_error(normalize_level("level"))).select(
        *more, "app_id", fingerprint(mode).alias("fingerprint"), "timestamp", "id", "message",
        exception_head_line("stack_trace", mode).alias("_head"),
        F.struct("file_name", "line_number", "method_name", "class_name").alias("_loc"))


def _running_clusters(stream: DataFrame, mode: str) -> DataFrame:
    return _cluster_rows(stream, mode).groupBy("app_id", "fingerprint").agg(*_cluster_totals(mode))


def finish_clusters(agg: DataFrame, mode: str, *more: str) -> DataFrame:
    """Cluster columns from the running aggregate, after the columns ``more``."""
    return agg.select(
        *more, "app_id", cluster_id("fingerprint").alias("cluster_id"), "fingerprint",
        class_of_head_line("_head", mode).alias("exception_class"),
        normalize_message("_message", mode).alias("message_pattern"),
        F.col("_loc.file_name").alias("primary_file"), F.col("_loc.line_number").alias("primary_line"),
        F.col("_loc.method_name").alias("primary_method"), F.col("_loc.class_name").alias("primary_class"),
        "first_seen", "last_seen", "occurrence_count", severity("occurrence_count").alias("severity"))


def stream_clusters(stream: DataFrame, state_path: str, checkpoint: str, mode: str = "cloud",
                    trigger: str | None = "5 seconds", available_now: bool = False, fold_every: int = 20):
    """R2: running count, first/last seen and newest attributes per
    ``(app_id, fingerprint)``; each micro-batch writes the changed clusters
    (full running totals, never deltas), and `read_changes` gives the table,
    which equals a batch scan of everything seen. A batch costs its changed
    clusters; the whole table is rewritten every ``fold_every`` batches."""
    agg = _running_clusters(stream, mode)

    def publish(batch: DataFrame, batch_id: int) -> None:
        write_changes(finish_clusters(batch, mode), state_path, batch_id + 1, fold_every=fold_every)

    w = (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(publish))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _seconds(duration: str) -> int:
    import re
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day|week)s?\s*", duration.lower())
    if not m:
        raise ValueError(f"window length not understood: {duration!r}")
    return int(m.group(1)) * _UNIT_SECONDS[m.group(2)]


def _wall_clock_start(spark, window: str) -> str:
    """Window start offset that lines windows up with the wall clock of the
    session time zone (event times stored without a zone are wall-clock
    times; windows count from the epoch in UTC)."""
    from datetime import datetime
    from zoneinfo import ZoneInfo
    tz = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
    offset = int(datetime(2024, 1, 1, tzinfo=tz).utcoffset().total_seconds())
    return f"{(-offset) % _seconds(window)} seconds"


def stream_scan(stream: DataFrame, window: str = "1 hour", watermark: str = "1 hour",
                mode: str = "cloud") -> DataFrame:
    """Clusters per event-time window and app, with all columns of a
    cluster (id, class, pattern, location, severity, as in a batch scan of
    the window's rows). Rows later than the watermark are dropped; a window is
    emitted once the watermark passes its end (append mode). The event time is
    cast to ``timestamp``, which a watermark requires. Windows start on the
    wall clock of the session time zone (an hour window runs from :00 to :00
    local time, also where the zone is not a whole number of hours from UTC)."""
    start = _wall_clock_start(stream.sparkSession, window)
    timed = (stream.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", watermark))
    rows = _cluster_rows(timed, mode, "event_time")
    w = F.window("event_time", window, startTime=start)
    agg = rows.groupBy(w.alias("w"), "app_id", "fingerprint").agg(*_cluster_totals(mode))
    agg = agg.withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end"))
    return finish_clusters(agg, mode, "window_start", "window_end")
