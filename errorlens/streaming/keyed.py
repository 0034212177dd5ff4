"""Ingest with application keys inside the stream (J4 in R1): accepted and
rejected rows in two day-partitioned tables, each row exactly once.

A micro-batch is decided once, in one pass: the application table as it is
then, one join, one write of both outcomes to a folder named by the batch's
number. The write's ``_SUCCESS`` commits the decision. Only then do the data
files go, by renames, to the two tables. A replayed batch whose decision is
committed isn't decided again, whatever the application table says by now: the
files still in its folder are moved, and nothing is left to do if there are
none. So a row is in one of the tables, never in both and never in neither.

Layout::

    staging/b=NNNNNN/accepted=<true|false>/log_date=<day>/    until moved
    accepted_path/log_date=<day>/    as `write_logs` lays out
    rejected_path/log_date=<day>/    the same, with ``reason``
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errorlens.functions.levels import at_least
from errorlens.operators.filters import enrich_location, enrich_trace_id
from errorlens.operators.state import _folder, _fs
from errorlens.operators.tenants import check_keys
from errorlens.sources.logs import to_log_schema, with_ingest_defaults

#: Numbers of past batches whose empty folders stay as a mark that they are done.
KEEP = 100


def decide_batch(batch: DataFrame, apps: DataFrame, staging: str, number: int, threshold: str | None = "WARN") -> bool:
    """Write both outcomes of a micro-batch to its folder; False when that
    was done before. Rows below ``threshold`` are in neither outcome; the key
    itself isn't stored."""
    spark, folder = batch.sparkSession, _folder(staging, "b", number)
    fs, p, jvm = _fs(spark, folder)
    if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
        return False
    rows = to_log_schema(batch, keep=["api_key"])
    rows = rows if threshold is None else rows.filter(at_least("level", threshold))
    rows = enrich_location(enrich_trace_id(rows), "first_user")
    rows = with_ingest_defaults(check_keys(rows, apps), keep=["accepted", "reason"])
    (rows.hint("rebalance", F.col("accepted"), F.col("log_date"))
         .sortWithinPartitions("accepted", "log_date", "app_id", "timestamp")
         .write.mode("overwrite").partitionBy("accepted", "log_date").parquet(folder))
    return True


def publish_batch(spark: SparkSession, staging: str, number: int, accepted_path: str, rejected_path: str) -> int:
    """Move the data files of a decided batch to the two tables and return
    how many were moved. A file keeps its name, which no other write has, after
    the batch's number; where a stopped move has left it in both places (a
    store without renames copies) the copy is made again."""
    fs, p, jvm = _fs(spark, _folder(staging, "b", number))
    Path, moved = jvm.org.apache.hadoop.fs.Path, 0
    for outcome, table in (("true", accepted_path), ("false", rejected_path)):
        here = Path(p, f"accepted={outcome}")
        for day in fs.listStatus(here) if fs.exists(here) else []:
            to = Path(f"{table.rstrip('/')}/{day.getPath().getName()}")
            fs.mkdirs(to)
            for st in fs.listStatus(day.getPath()):
                name = st.getPath().getName()
                if not name.endswith(".parquet"):
                    continue
                goal = Path(to, f"b{number:06d}-{name}")
                if fs.exists(goal):
                    fs.delete(goal, False)
                if not fs.rename(st.getPath(), goal):
                    raise OSError(f"{st.getPath()} could not be moved to {goal}")
                moved += 1
    old = Path(_folder(staging, "b", number - KEEP))
    if number >= KEEP and fs.exists(old):  # long done: a query replays its last batch only
        fs.delete(old, True)
    return moved


def ingest_keyed_stream(stream: DataFrame, apps: Callable[[], DataFrame], accepted_path: str, rejected_path: str,
                        staging: str, checkpoint: str, threshold: str | None = "WARN",
                        trigger: str | None = "5 seconds", available_now: bool = False):
    """R1 with J4: rows of ``stream`` (log columns and ``api_key``) at or above
    ``threshold``, enriched as by `ingest_stream`, to ``accepted_path`` where
    ``(app_id, api_key)`` is an application's, else to ``rejected_path`` with
    the ``reason``. ``apps`` is called for each micro-batch, so keys that are
    added or withdrawn count from the next batch on. ``staging`` must be on the
    file system of the two tables and belongs to this query's ``checkpoint``."""
    def both(batch: DataFrame, number: int) -> None:
        decide_batch(batch, apps(), staging, number, threshold)
        publish_batch(batch.sparkSession, staging, number, accepted_path, rejected_path)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(both)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()
