"""Application scoping and analysis joins.

"Newest row per key" is a ``max_by`` aggregate on ``(created_at, id)``, not a
window: it is partial-aggregated, so a key with a third of all rows costs
one buffer per map task. Joins with the application table are plain joins:
AQE turns them into broadcast joins when the runtime size of that side is
under ``spark.sql.autoBroadcastJoinThreshold`` and keeps a shuffle join
beyond it, so no unbounded table is ever broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorlens.functions.levels import is_error


def newest_per(df: DataFrame, key: str, order=("created_at", "id")) -> DataFrame:
    """The newest row of each ``key`` by ``order`` (ties cannot occur when
    ``order`` ends with a unique id)."""
    cols = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each cluster."""
    return newest_per(analyses, "cluster_id")


def latest_error_per_app(logs: DataFrame) -> DataFrame:
    """The newest ERROR/FATAL row of each application."""
    return newest_per(logs.filter(is_error("level")), "app_id", order=("timestamp", "id"))


def cluster_summary(state: DataFrame, apps: DataFrame, analyses: DataFrame) -> DataFrame:
    """Stored clusters with their application name and newest analysis.

    ``has_patch`` is false when there is no analysis; ``analyzed_at`` is the
    time of the newest analysis.
    """
    newest = latest_analysis(analyses).select(
        F.col("cluster_id").alias("id"), "explanation", "root_cause", "recommendation",
        F.col("patch").isNotNull().alias("_has_patch"),
        F.col("confidence").alias("analysis_confidence"),
        F.col("created_at").alias("analyzed_at"))
    named = state.join(apps.select("app_id", F.col("name").alias("app_name")), "app_id")
    out = named.join(newest, "id", "left")
    return out.select(
        "id", "app_id", "app_name", "fingerprint", "exception_class", "message_pattern",
        "primary_class", "primary_method", "primary_line", "occurrence_count", "severity",
        "status", "first_seen", "last_seen", "explanation", "root_cause", "recommendation",
        F.coalesce("_has_patch", F.lit(False)).alias("has_patch"),
        "analysis_confidence", "analyzed_at")


def user_apps(apps: DataFrame, user_id: str) -> DataFrame:
    return apps.filter(F.col("user_id") == user_id).select("app_id")


def scope_to_user(df: DataFrame, apps: DataFrame, user_id: str) -> DataFrame:
    """Rows (logs, clusters, scans) whose application belongs to the
    user; a left-semi join, so rows are never duplicated."""
    return df.join(user_apps(apps, user_id), "app_id", "left_semi")


def scope_analyses_to_user(analyses: DataFrame, state: DataFrame, apps: DataFrame,
                           user_id: str) -> DataFrame:
    """Analyses whose cluster belongs to one of the user's apps."""
    owned = scope_to_user(state.select("id", "app_id"), apps, user_id).select(
        F.col("id").alias("cluster_id"))
    return analyses.join(owned, "cluster_id", "left_semi")


def accept_by_key(batch: DataFrame, apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``(app_id, api_key)`` matches an application, and the
    rejected rest."""
    keys = apps.select("app_id", "api_key")
    return (batch.join(keys, ["app_id", "api_key"], "left_semi"),
            batch.join(keys, ["app_id", "api_key"], "left_anti"))


def check_keys(batch: DataFrame, apps: DataFrame) -> DataFrame:
    """J4 in one pass: ``batch`` with ``accepted`` and, for the others, the
    ``reason``. An application may have several keys; a null id or key matches
    nothing. Batch columns named ``accepted`` or ``reason`` are replaced."""
    held = apps.filter(F.col("app_id").isNotNull()).groupBy(F.col("app_id").alias("_app")).agg(
        F.collect_set("api_key").alias("_keys"))
    j = batch.join(held, batch["app_id"] == held["_app"], "left")
    ok = F.coalesce(F.array_contains("_keys", F.col("api_key")), F.lit(False))
    why = F.when(F.col("_app").isNull(), "unknown application").when(~F.col("accepted"), "wrong key")
    return j.withColumn("accepted", ok).withColumn("reason", why).drop("_app", "_keys")


def attach_analysis(clusters: DataFrame, analyses: DataFrame, key: str = "id") -> DataFrame:
    """Each cluster with its newest analysis, if any (left join)."""
    newest = latest_analysis(analyses)
    renamed = newest.select(F.col("cluster_id").alias(key),
                            *[F.col(c).alias(f"analysis_{c}") for c in newest.columns
                              if c != "cluster_id"])
    return clusters.join(renamed, key, "left")


def apps_by_created(apps: DataFrame) -> DataFrame:
    """Applications, newest first."""
    return apps.orderBy(F.desc("created_at"), F.asc("app_id"))
