"""Health report tables.

Each report table is one aggregate over the log table plus, where a
cluster figure is needed, a scalar subquery over the cluster table. Nothing
is collected to the driver; the one-row tables are ordinary DataFrames that
the caller writes (see ``sources.reports``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errorlens.functions.levels import is_error, level_rank


def count_by_level(logs: DataFrame) -> DataFrame:
    """A1: rows per canonical level (all time, or over the rows given)."""
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("count"))


def level_distribution(logs: DataFrame) -> DataFrame:
    """Count and percent of total per level, in level order; levels
    with no rows are left out. The window spans at most six rows."""
    counts = count_by_level(logs)
    total = F.sum("count").over(Window.partitionBy())
    return (counts.select("level", "count",
                          (F.col("count") / total * 100).alias("percent"),
                          level_rank("level").alias("level_rank"))
            .orderBy("level_rank"))


def report_summary(logs: DataFrame, clusters: DataFrame) -> DataFrame:
    """A5: one row: total logs, error logs, error rate in percent (0 when
    there are no logs), cluster count, critical and high cluster counts."""
    stats = clusters.select(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"))).scalar()
    total = F.count(F.lit(1))
    errs = F.count_if(is_error("level"))
    # the subquery is bound to one column first: reading its three fields
    # straight from the expression would plan (and run) it three times
    base = logs.agg(total.alias("total_logs"), errs.alias("error_logs")).withColumn("_s", stats)
    return base.select(
        "total_logs", "error_logs",
        F.when(F.col("total_logs") == 0, F.lit(0.0))
        .otherwise(F.col("error_logs") / F.col("total_logs") * 100).alias("error_rate"),
        F.col("_s.n").alias("cluster_count"),
        F.col("_s.critical").alias("critical_count"),
        F.col("_s.high").alias("high_count"))


def health_status(summary: DataFrame) -> DataFrame:
    """CRITICAL if any critical cluster, WARNING if any high, ATTENTION
    if any error, else HEALTHY."""
    return summary.withColumn("health", health_expr())


def health_expr() -> Column:
    return (F.when(F.col("critical_count") > 0, F.lit("CRITICAL"))
            .when(F.col("high_count") > 0, F.lit("WARNING"))
            .when(F.col("error_logs") > 0, F.lit("ATTENTION"))
            .otherwise(F.lit("HEALTHY")))


def summary_flags(summary: DataFrame) -> DataFrame:
    """Warning flags of the summary figures."""
    return summary.select(
        "*",
        (F.col("error_logs") > 100).alias("errors_warning"),
        (F.col("error_rate") > 5).alias("rate_warning"),
        (F.col("critical_count") > 0).alias("has_critical"),
        (F.col("high_count") > 0).alias("has_high"))


def app_stats(logs: DataFrame, clusters: DataFrame, apps: DataFrame) -> DataFrame:
    """A4: per application: total logs, error logs, clusters, critical
    clusters, newest error time. Applications without logs get 0 and null.

    Both sides are aggregated to one row per app before the joins, so the
    joins move a handful of rows whatever the size of the log table.
    """
    per_log = logs.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(is_error("level")).alias("error_logs"),
        F.max(F.when(is_error("level"), F.col("timestamp"))).alias("last_error"))
    per_cluster = clusters.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("cluster_count"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"))
    out = apps.select("app_id").join(per_log, "app_id", "left").join(per_cluster, "app_id", "left")
    return out.select(
        "app_id",
        F.coalesce("total_logs", F.lit(0)).alias("total_logs"),
        F.coalesce("error_logs", F.lit(0)).alias("error_logs"),
        F.coalesce("cluster_count", F.lit(0)).alias("cluster_count"),
        F.coalesce("critical_count", F.lit(0)).alias("critical_count"),
        "last_error")


def scan_metrics(scanned: DataFrame, clusters: DataFrame, mode: str = "core") -> DataFrame:
    """One row for the run record: rows scanned, errors found, clusters
    created. cloud counts only error rows, so errors found = rows scanned."""
    n_clusters = clusters.select(F.count(F.lit(1))).scalar()
    errs = F.count(F.lit(1)) if mode == "cloud" else F.count_if(is_error("level"))
    return scanned.agg(F.count(F.lit(1)).alias("logs_scanned"), errs.alias("errors_found")).select(
        "logs_scanned", "errors_found", n_clusters.alias("clusters_created"))


def observe_scan(scanned: DataFrame, name: str = "scan"):
    """A9 without a second pass: attach an ``Observation`` that counts the
    scanned and error rows while the scan runs for its main result."""
    from pyspark.sql import Observation
    obs = Observation(name)
    observed = scanned.observe(obs, F.count(F.lit(1)).alias("logs_scanned"),
                               F.count_if(is_error("level")).alias("errors_found"))
    return observed, obs
