"""Health report (lifecycle D) and its JSON sink.

The report is a handful of small tables computed from the log table of a
period: the summary row, the level distribution, the ranked clusters and,
when given, each cluster's newest analysis. ``report_tables`` returns them
as DataFrames; ``write_report_json`` writes each as JSON lines, and
``report_document`` builds the single JSON document of the command-line
report (summary, levels and the top ten clusters, so its size is bounded).
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorlens.functions.fingerprints import location_key
from errorlens.operators.clusters import cluster_errors, rank_clusters
from errorlens.operators.filters import in_last, ts_value
from errorlens.operators.report import health_status, level_distribution, report_summary, summary_flags
from errorlens.operators.tenants import attach_analysis
from errorlens.session import checkpoint


def report_tables(logs: DataFrame, asof, lookback: str = "24h", mode: str = "core",
                  analyses: DataFrame | None = None) -> dict[str, DataFrame]:
    """The report of the period ``lookback`` ending at ``asof``. The cluster
    table is made once and read by every table that needs it."""
    period = in_last(logs, asof, lookback, timedelta(hours=24))
    clusters = checkpoint(cluster_errors(period, mode=mode))
    summary = summary_flags(health_status(report_summary(period, clusters)))
    tables = {"summary": summary, "levels": level_distribution(period), "clusters": rank_clusters(clusters)}
    if analyses is not None:
        tables["analyses"] = attach_analysis(clusters.withColumnRenamed("cluster_id", "id"), analyses)
    return tables


def write_report_json(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Every report table as JSON lines under ``path/<name>``."""
    for name, df in tables.items():
        df.write.mode(mode).json(f"{path.rstrip('/')}/{name}")


def report_document(logs: DataFrame, asof, lookback: str = "24h", mode: str = "core",
                    top: int = 10) -> DataFrame:
    """S5 (document form): one row, one ``json`` column: generation time
    (``asof``), period, totals, counts per level and the top clusters in
    rank order. Every gathered list is bounded (six levels, ``top``
    clusters)."""
    end = ts_value(logs, asof)
    period = in_last(logs, asof, lookback, timedelta(hours=24))
    clusters = checkpoint(cluster_errors(period, mode=mode))
    summary = report_summary(period, clusters)
    ranked = F.array_sort(F.collect_list(F.struct("level_rank", "level", "count")))
    levels = level_distribution(period).select(F.map_from_entries(F.transform(
        ranked, lambda e: F.struct(e["level"], e["count"]))).alias("m")).select("m").scalar()
    entry = F.struct(
        (-F.col("occurrence_count")).alias("o"), (-F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("l"),
        F.col("fingerprint").alias("f"),
        F.struct(F.col("cluster_id").alias("id"), F.col("exception_class").alias("exceptionClass"),
                 F.col("occurrence_count").alias("occurrences"), F.col("severity"),
                 F.col("first_seen").cast("string").alias("firstSeen"),
                 F.col("last_seen").cast("string").alias("lastSeen"),
                 location_key("primary_class", "primary_method", "primary_line").alias("location")).alias("c"))
    listed = (rank_clusters(clusters).limit(top).select(entry.alias("e"))
              .agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["c"]).alias("c"))
              .select("c").scalar())
    return summary.select(F.to_json(F.struct(
        end.cast("string").alias("generated"),
        F.struct(F.lit(lookback).alias("lookback"), end.cast("string").alias("end")).alias("period"),
        F.struct(F.col("total_logs").alias("totalLogs"), F.col("error_logs").alias("errorLogs"),
                 F.col("cluster_count").alias("uniqueClusters")).alias("summary"),
        levels.alias("levelDistribution"),
        listed.alias("clusters"))).alias("json"))
