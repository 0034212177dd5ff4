"""Scans (lifecycles A and B) composed from the operators.

``scan``: read logs -> errors of the lookback -> fingerprint -> clusters ->
rank -> top n; one shuffle at the group-by and one top-k.
``cloud_scan``: errors of one app since ``asof - hours`` -> clusters
(cloud rules) -> upsert into the stored state -> run record.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorlens.operators.clusters import capped_scan, cluster_errors, top_clusters
from errorlens.operators.filters import errors, for_app, in_last, since, ts_value
from errorlens.operators.report import observe_scan, scan_metrics
from errorlens.operators.state import append_events, scan_event, upsert_clusters, write_app_changes, write_snapshot
from errorlens.session import checkpoint


def scan(logs: DataFrame, asof, lookback: str = "1h", top: int = 5, mode: str = "core") -> dict[str, DataFrame]:
    """Lifecycle A: clusters of the errors in the lookback (default 1 h)."""
    period = errors(in_last(logs, asof, lookback, timedelta(hours=1)))
    clusters = checkpoint(cluster_errors(period, mode=mode))
    return {"clusters": clusters, "top": top_clusters(clusters, top)}


def cloud_scan(logs: DataFrame, state: DataFrame, app_id: str, asof, hours: float = 24,
               cap: int | None = None, scan_id: str = "scan") -> dict[str, DataFrame]:
    """Lifecycle B: the next cluster state of one app and the run's closing
    event (errors found = rows scanned, as in the cloud form)."""
    rows = errors(since(for_app(logs, app_id), asof, hours))
    if cap is not None:
        rows = capped_scan(rows, cap)
    clusters = checkpoint(cluster_errors(rows, mode="cloud"))
    app_state = for_app(state, app_id)
    next_state = upsert_clusters(app_state, clusters, asof)
    metrics = scan_metrics(rows, clusters, mode="cloud")
    at = ts_value(logs, asof)
    event = metrics.select(*scan_event(F.lit(scan_id), F.lit(app_id), "COMPLETED", at, {
        "logs_scanned": F.col("logs_scanned"), "errors_found": F.col("errors_found"),
        "clusters_created": F.col("clusters_created")}))
    return {"clusters": clusters, "state": next_state, "event": event}


def run_cloud_scan(logs: DataFrame, state: DataFrame, app_id: str, asof, state_path: str,
                   hours: float = 24, cap: int | None = None, scan_id: str = "scan",
                   events_path: str | None = None, per_app: bool = False) -> dict:
    """Lifecycle B as one job: the scan's rows are counted by an
    ``Observation`` while they are clustered (no second pass for the run
    record), the clusters are checkpointed once, the next state (this app's
    clusters and the other apps' as they were) is written as a new snapshot
    version, and the closing event is returned as a one-row DataFrame with
    ``state_path``.

    With ``per_app`` only this app's changed rows are written, into its own folder
    below ``state_path`` (`write_app_changes`; read all by `read_app_states`):
    the cost is that of the app's scan, and scans of different apps can run at
    once. Without it a scan rewrites the table of all apps, and of two
    at once the later one wins.

    With ``events_path`` a RUNNING event is added to that table before the
    scan, and a COMPLETED or FAILED event (with the error's text; the error
    is raised again) after it."""
    spark, at = logs.sparkSession, ts_value(logs, asof)

    def event(status: str, metrics: dict | None = None, error: str | None = None) -> DataFrame:
        row = spark.range(1).select(*scan_event(F.lit(scan_id), F.lit(app_id), status, at, metrics, F.lit(error)))
        if events_path is not None:
            append_events(row, events_path)
        return row

    if events_path is not None:
        event("RUNNING")
    try:
        rows = errors(since(for_app(logs, app_id), asof, hours))
        if cap is not None:
            rows = capped_scan(rows, cap)
        observed, obs = observe_scan(rows, f"scan-{scan_id}")
        clusters = checkpoint(cluster_errors(observed, mode="cloud"))
        scanned = obs.get.get("logs_scanned", 0)
        if per_app:
            path = write_app_changes(state, clusters, app_id, state_path, asof)
        else:
            mine = upsert_clusters(for_app(state, app_id), clusters, asof)
            others = state.where(~F.col("app_id").eqNullSafe(F.lit(app_id)))
            path = write_snapshot(mine.unionByName(others.select(*mine.columns)), state_path)
        n_clusters = clusters.count()
    except Exception as e:
        if events_path is not None:
            event("FAILED", error=str(e))
        raise
    done = event("COMPLETED", {"logs_scanned": F.lit(scanned), "errors_found": F.lit(scanned),
                               "clusters_created": F.lit(n_clusters)})
    return {"state_path": path, "event": done}
