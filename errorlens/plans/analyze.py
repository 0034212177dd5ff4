"""Analysis of clusters (lifecycle E) as one batch job.

samples (J5) or newest entries (W2) -> prompts (L1/L2) -> caller's model
(L5) -> sections and confidence (L6, L7) -> analysis rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorlens.functions.responses import confidence, parse_response
from errorlens.operators.clusters import most_recent_entry, newest_entries, with_fingerprint
from errorlens.operators.insight import analysis_prompts, cloud_analysis_prompts, complete, sample_logs_by_pattern
from errorlens.operators.ledger import complete_with_ledger


def analyze(logs: DataFrame, clusters: DataFrame, model: Callable[[str], str | None],
            context: DataFrame | None = None, mode: str = "core", asof=None,
            partitions: int | None = None, ledger: str | None = None, model_name: str = "") -> DataFrame:
    """One analysis row per answered cluster: sections, patch, confidence,
    answer. With ``ledger`` answers are kept there and a rerun calls the model
    for the missing ones only (see `complete_with_ledger`). Clusters with an ``app_id`` are joined to entries of their own
    application only, and its column is kept. A failed call gives no row,
    so it never hides an earlier analysis."""
    by = ["app_id"] if "app_id" in clusters.columns else []
    if "newest_id" in clusters.columns:
        newest = newest_entries(logs, clusters, by)
        clusters = clusters.drop("newest_id")
    else:
        fp = with_fingerprint(logs, mode).select(*by, "fingerprint", "id", "timestamp", "stack_trace", "message")
        newest = most_recent_entry(fp, by)
    prompts = analysis_prompts(clusters, newest, context, by=by)
    return _analyses(_answered(prompts, model, partitions, ledger, model_name), mode, asof, by)


def analyze_cloud(logs: DataFrame, clusters: DataFrame, model: Callable[[str], str | None], asof=None,
                  partitions: int | None = None, samples: int = 3, prefix: int | None = 50,
                  ledger: str | None = None, model_name: str = "") -> DataFrame:
    """Lifecycle E as the hosted form runs it: pattern samples (J5, the first
    ``prefix`` chars of the pattern, 50 there; None: all) feed the prompt of each cluster (``app_id``,
    ``fingerprint``); answers are parsed by the cloud rules."""
    found = sample_logs_by_pattern(clusters, logs, samples, prefix=prefix)
    prompts = cloud_analysis_prompts(clusters, found)
    return _analyses(_answered(prompts, model, partitions, ledger, model_name), "cloud", asof, ["app_id"])


def _answered(prompts: DataFrame, model: Callable[[str], str | None], partitions: int | None, ledger: str | None,
              model_name: str) -> DataFrame:
    rows = (complete(prompts, model, partitions) if ledger is None
            else complete_with_ledger(prompts, model, ledger, model_name))
    return rows.where(F.col("response").isNotNull())


def _analyses(answered: DataFrame, mode: str, asof, by: list[str]) -> DataFrame:
    parsed = answered.select(*by, "cluster_id", "fingerprint", "response",
                             parse_response("response", mode).alias("p"),
                             confidence("response", mode).alias("confidence"))
    created = F.lit(asof) if asof is not None else F.current_timestamp()
    key = [F.concat(F.coalesce(F.col("app_id"), F.lit("")), F.lit(":"))] if by else []
    return parsed.select(
        F.concat(*key, "cluster_id", F.lit("#"), F.sha2("response", 256).substr(1, 12)).alias("id"),
        *by, "cluster_id", "fingerprint", F.col("p.explanation").alias("explanation"), F.col("p.root_cause").alias("root_cause"),
        F.col("p.recommendation").alias("recommendation"), F.col("p.patch").alias("patch"),
        F.lit(None).cast("string").alias("patch_file_name"), "confidence",
        F.col("response").alias("raw_response"), created.alias("created_at"))
