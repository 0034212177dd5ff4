"""Clusters and report figures from daily partials (A1, A2, A4, A5).

A day of the stored log table is aggregated once: rows by (app, level), and
error rows by (app, fingerprint) with, of every "newest row that ..." pick, the
value and the order key it was picked by. Such rows merge: a report over seven
days adds up seven small tables and reads no log row.

Layout of a partial table, one for each mode::

    base/levels/b=<batch>/log_date=<day>/     app_id, level, count, last_seen
    base/clusters/b=<batch>/log_date=<day>/   one row an (app, fingerprint)
    base/days/v=NNNNNN/                       log_date, files, b

``days`` names for each day the batch that holds it and a digest of the data
files it was made from. It is written last, so a batch of a job that stopped
is never read and its days are simply made again. One job refreshes a partial
table at a time; readers may run meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errorlens.functions.levels import is_error
from errorlens.operators.clusters import ORDER_KEY, cluster_rows, clusters_of
from errorlens.operators.newest import _days as stored_days
from errorlens.operators.state import _fs, read_snapshot, write_snapshot
from errorlens.schema import LOG_SCHEMA
from errorlens.sources.logs import day_folders

DAYS = "log_date date, files string, b string"


def _order() -> Column:
    return F.struct(*[F.col(c) for c in ORDER_KEY])


def level_partials(logs: DataFrame) -> DataFrame:
    """Rows by (log_date, app_id, level), with the newest time."""
    return logs.groupBy("log_date", "app_id", "level").agg(
        F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("last_seen"))


def cluster_partials(logs: DataFrame, mode: str = "core", frames: int = 5) -> DataFrame:
    """Error rows by (log_date, app_id, fingerprint): count, seen range, and
    of message, trace head and location the value of the newest row that
    counts in this mode, with that row's order key (null: no such row)."""
    at = _order()
    rows = cluster_rows(logs, ["log_date", "app_id"], mode, frames)
    core = mode == "core"
    head_at = F.when(F.col("_head").isNotNull(), at) if core else at
    loc_at = F.when(F.col("file_name").isNotNull(), at) if core else at
    return rows.groupBy("log_date", "app_id", "fingerprint").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.max_by("message", at).alias("_message"), F.max(at).alias("_at"),
        F.max_by("_head", head_at).alias("_head"), F.max(head_at).alias("_head_at"),
        F.max_by(F.struct("file_name", "line_number", "method_name", "class_name"), loc_at).alias("_loc"),
        F.max(loc_at).alias("_loc_at"))


def merge_cluster_partials(partials: DataFrame, mode: str = "core") -> DataFrame:
    """A2 from partials of any days: what `cluster_errors` gives over their
    log rows (all apps together in core mode, by app in cloud mode). No
    partials give no clusters."""
    keys = [] if mode == "core" else ["app_id"]
    agg = partials.groupBy(*keys, "fingerprint").agg(
        F.sum("occurrence_count").alias("occurrence_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("_message", "_at").alias("_message"),
        F.max_by("_head", "_head_at").alias("_head"), F.max_by("_loc", "_loc_at").alias("_loc"))
    return clusters_of(agg, keys, mode)


def merge_level_partials(partials: DataFrame) -> DataFrame:
    """A1 from partials: rows by level."""
    return partials.groupBy("level").agg(F.sum("count").alias("count"))


def summary_of_partials(levels: DataFrame, clusters: DataFrame) -> DataFrame:
    """A5 from level partials and merged clusters; zeros when there are none."""
    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    stats = clusters.select(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"))).scalar()
    rows = levels.agg(total(F.col("count")).alias("total_logs"),
                      total(F.when(is_error("level"), F.col("count"))).alias("error_logs")).withColumn("_s", stats)
    return rows.select(
        "total_logs", "error_logs",
        F.when(F.col("total_logs") == 0, F.lit(0.0))
        .otherwise(F.col("error_logs") / F.col("total_logs") * 100).alias("error_rate"),
        F.col("_s.n").alias("cluster_count"), F.col("_s.critical").alias("critical_count"),
        F.col("_s.high").alias("high_count"))


def app_stats_of_partials(levels: DataFrame, clusters: DataFrame, apps: DataFrame) -> DataFrame:
    """A4 from level partials and merged clusters of cloud mode."""
    err = is_error("level")
    per_log = levels.groupBy("app_id").agg(
        F.sum("count").alias("total_logs"), F.sum(F.when(err, F.col("count"))).alias("error_logs"),
        F.max(F.when(err, F.col("last_seen"))).alias("last_error"))
    per_cluster = clusters.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("cluster_count"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"))
    out = apps.select("app_id").join(per_log, "app_id", "left").join(per_cluster, "app_id", "left")
    figures = ("total_logs", "error_logs", "cluster_count", "critical_count")
    return out.select("app_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in figures], "last_error")


# ---------------------------------------------------------------- the stored partials

def day_digests(spark: SparkSession, logs_path: str) -> dict[str, str]:
    """For each day of a table that `write_logs` wrote a digest of the names,
    sizes and times of its data files. Spark lists the files, none is opened;
    the driver gets one row a day."""
    if not day_folders(spark, logs_path):
        return {}
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .load(f"{logs_path.rstrip('/')}/log_date=*").select("path", "length", "modificationTime"))
    day = F.regexp_extract("path", r"/log_date=([0-9-]+)/[^/]*$", 1)
    each = F.xxhash64("path", "length", "modificationTime")
    # sums of hashes: order doesn't matter and no list of a day's files is gathered
    got = files.where(day != "").groupBy(day.alias("day")).agg(
        F.count(F.lit(1)), F.sum(F.pmod(each, F.lit(1 << 40))), F.sum(F.shiftrightunsigned(each, 40))).collect()
    return {r[0]: "-".join(str(x) for x in r[1:]) for r in got}


def _held(spark: SparkSession, base: str) -> dict[str, tuple[str, str]]:
    days = read_snapshot(spark, f"{base}/days")
    return {} if days is None else {str(r["log_date"]): (r["files"], r["b"]) for r in days.collect()}


def refresh_partials(spark: SparkSession, logs_path: str, base: str, mode: str = "core", frames: int = 5) -> list[str]:
    """Bring the partial table ``base`` up to date with the log table and
    return the days that were aggregated, ascending.

    Only days whose data files changed are read (new days, days with late
    rows, the cutoff's day after a retention run); days that are gone leave the
    table. A row that lands while its day is read may be in the partial
    already; its file changes the day's digest, so the next refresh makes
    the day again. Unchanged tables cost the listing only."""
    base = base.rstrip("/")
    now, held = day_digests(spark, logs_path), _held(spark, base)
    stale = sorted(d for d, files in now.items() if held.get(d, ("", ""))[0] != files)
    if not stale and set(held) == set(now) and held:
        return []
    batch = f"x{uuid.uuid4().hex}"
    if stale:
        logs = stored_days(spark, logs_path.rstrip("/"), stale)
        for name, rows in (("levels", level_partials(logs)), ("clusters", cluster_partials(logs, mode, frames))):
            (rows.hint("rebalance", F.col("log_date")).write.mode("overwrite").partitionBy("log_date")
             .parquet(f"{base}/{name}/b={batch}"))
    days = [(d, files, batch if d in stale else held[d][1]) for d, files in sorted(now.items())]
    rows = spark.createDataFrame(days, "day string, files string, b string")
    write_snapshot(rows.select(F.col("day").cast("date").alias("log_date"), "files", "b").coalesce(1), f"{base}/days")
    _drop_unused(spark, base, {b for _, _, b in days} | {b for _, b in held.values()})
    return stale


def _drop_unused(spark: SparkSession, base: str, used: set[str]) -> None:
    """Remove batches that neither this list of days nor the one before it
    (which a reader may hold) names."""
    for name in ("levels", "clusters"):
        fs, p, _ = _fs(spark, f"{base}/{name}")
        for st in fs.listStatus(p) if fs.exists(p) else []:
            if st.getPath().getName().removeprefix("b=") not in used:
                fs.delete(st.getPath(), True)


def read_partials(spark: SparkSession, base: str, first: str | None = None, last: str | None = None,
                  mode: str = "core") -> tuple[DataFrame, DataFrame]:
    """Level and cluster partials of the days ``first`` to ``last`` (both
    included, null: no bound). Only the folders of these days are read; a
    table that was never refreshed, or has no such day, gives empty ones."""
    base = base.rstrip("/")
    days = [(b, d) for d, (_, b) in _held(spark, base).items()
            if (first is None or d >= first) and (last is None or d <= last)]
    logs = spark.createDataFrame([], LOG_SCHEMA).withColumn("log_date", F.lit(None).cast("date"))
    out = []
    for name, empty in (("levels", level_partials(logs)), ("clusters", cluster_partials(logs, mode))):
        if not days:
            out.append(empty)
            continue
        fields = empty.schema.add("b", "string")
        rows = spark.read.schema(fields).parquet(f"{base}/{name}")
        # both columns are folders: this prunes the listing's partitions
        wanted = F.concat_ws("/", "b", F.col("log_date").cast("string")).isin([f"{b}/{d}" for b, d in days])
        out.append(rows.where(wanted).drop("b"))
    return out[0], out[1]
