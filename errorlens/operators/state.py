"""Cluster state across scans (U1, U2, U4, U5) and snapshot storage.

State tables are rewritten as whole new snapshots (no row-level writes):
one full outer join of the stored state with the new scan gives the next
state, which is written to a new version folder; readers always take the
newest complete version, so the folder being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errorlens.operators.tenants import newest_per

KEY = ["app_id", "fingerprint"]
SCAN_FIELDS = ["exception_class", "message_pattern", "primary_file", "primary_line",
               "primary_method", "primary_class", "occurrence_count", "severity",
               "first_seen", "last_seen"]
STATE_COLUMNS = ["id", "app_id", "fingerprint", *SCAN_FIELDS, "status", "created_at", "updated_at"]


def _ts(value, like: DataFrame, col: str) -> Column:
    c = value if isinstance(value, Column) else F.lit(value)
    return c.cast(like.schema[col].dataType)


def upsert_clusters(state: DataFrame, scan: DataFrame, asof) -> DataFrame:
    """Next cluster state, keyed by ``(app_id, fingerprint)``.

    Matched: the scan's figures replace count, severity, first/last seen,
    pattern, class and location; ``id``, ``status`` and ``created_at`` stay;
    ``updated_at`` becomes ``asof``. New clusters: status OPEN, id
    ``app_id:cluster_id``, created and updated at ``asof``. Clusters the scan
    did not see are kept as they were. A null severity reads as MEDIUM.
    """
    s = state.select(*[F.col(c).alias(f"s_{c}") for c in STATE_COLUMNS])
    n = scan.select(*KEY, "cluster_id", *SCAN_FIELDS)
    j = s.join(n, (s["s_app_id"] == n["app_id"]) & (s["s_fingerprint"] == n["fingerprint"]), "full_outer")
    seen = F.col("fingerprint").isNotNull()
    known = F.col("s_fingerprint").isNotNull()
    at = _ts(asof, state, "updated_at")
    out = [
        F.when(known, F.col("s_id")).otherwise(
            F.concat(F.col("app_id"), F.lit(":"), F.col("cluster_id"))).alias("id"),
        F.coalesce("s_app_id", "app_id").alias("app_id"),
        F.coalesce("s_fingerprint", "fingerprint").alias("fingerprint"),
    ]
    for c in SCAN_FIELDS:
        val = F.when(seen, F.col(c)).otherwise(F.col(f"s_{c}"))
        if c == "severity":
            val = F.coalesce(val, F.lit("MEDIUM"))
        out.append(val.alias(c))
    out += [
        F.when(known, F.col("s_status")).otherwise(F.lit("OPEN")).alias("status"),
        F.when(known, F.col("s_created_at")).otherwise(at).alias("created_at"),
        F.when(seen, at).otherwise(F.col("s_updated_at")).alias("updated_at"),
    ]
    return j.select(*out)


def increment_clusters(state: DataFrame, hits: DataFrame, asof, key: str = "id") -> DataFrame:
    """Add occurrences to known clusters; ``last_seen`` of a hit cluster
    becomes ``asof``; severity is left alone. ``hits`` holds one row per
    occurrence with the cluster ``id``; they are counted before the join,
    so one batch replaces one call per occurrence."""
    counts = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_hits"))
    j = state.join(counts, key, "left")
    at = _ts(asof, state, "last_seen")
    return j.select(*[
        (F.col(c) + F.coalesce("_hits", F.lit(0))).cast(state.schema[c].dataType).alias(c)
        if c == "occurrence_count" else
        F.when(F.col("_hits").isNotNull(), at).otherwise(F.col(c)).alias(c)
        if c == "last_seen" else F.col(c)
        for c in state.columns])


# ---------------------------------------------------------------- U4

SCAN_EVENT_COLUMNS = ["scan_id", "app_id", "status", "event_time", "logs_scanned",
                      "errors_found", "clusters_created", "clusters_analyzed",
                      "error_message", "scan_config"]


def scan_history(events: DataFrame) -> DataFrame:
    """U4: current row of every scan from its append-only events.

    A scan writes a RUNNING event when it starts and a COMPLETED or FAILED
    event with its figures when it ends; the current row is the newest
    event, ``started_at`` the time of the RUNNING event and
    ``completed_at`` the time of the closing event.
    """
    newest = F.max_by(F.struct(*[c for c in SCAN_EVENT_COLUMNS if c not in ("scan_id",)]),
                      F.struct("event_time", F.when(F.col("status") == "RUNNING", 0).otherwise(1)))
    agg = events.groupBy("scan_id").agg(
        newest.alias("_e"),
        F.min(F.when(F.col("status") == "RUNNING", F.col("event_time"))).alias("started_at"),
        F.max(F.when(F.col("status") != "RUNNING", F.col("event_time"))).alias("completed_at"))
    return agg.select(
        "scan_id", F.col("_e.app_id").alias("app_id"), F.col("_e.status").alias("status"),
        "started_at", "completed_at",
        *[F.coalesce(F.col(f"_e.{c}"), F.lit(0)).alias(c) for c in
          ("logs_scanned", "errors_found", "clusters_created", "clusters_analyzed")],
        F.col("_e.error_message").alias("error_message"),
        F.col("_e.scan_config").alias("scan_config"))


def scan_event(scan_id: Column, app_id: Column, status: str, at: Column,
               metrics: dict[str, Column] | None = None, error: Column | None = None,
               config: Column | None = None) -> list[Column]:
    """Columns of one scan event row (for ``select`` over a metrics frame)."""
    m = metrics or {}
    return [scan_id.alias("scan_id"), app_id.alias("app_id"), F.lit(status).alias("status"),
            at.alias("event_time"),
            *[m.get(c, F.lit(None)).cast("bigint").alias(c) for c in
              ("logs_scanned", "errors_found", "clusters_created", "clusters_analyzed")],
            (error if error is not None else F.lit(None)).cast("string").alias("error_message"),
            (config if config is not None else F.lit(None)).cast("string").alias("scan_config")]


def append_events(events: DataFrame, path: str) -> None:
    """Add scan events to the event table at ``path``."""
    events.select(*SCAN_EVENT_COLUMNS).coalesce(1).write.mode("append").parquet(path)


# ---------------------------------------------------------------- U5

def attach_patch(analyses: DataFrame, patches: DataFrame) -> DataFrame:
    """Put each patch on the newest analysis of its cluster, or add an
    analysis row (confidence MEDIUM) when the cluster has none.

    ``patches``: ``cluster_id, patch, patch_file_name, created_at``, one row
    per cluster.
    """
    newest_ids = newest_per(analyses, "cluster_id").select(
        "cluster_id", F.col("id").alias("_newest_id"))
    p = patches.select("cluster_id", F.col("patch").alias("_p"),
                       F.col("patch_file_name").alias("_pf"))
    hit = newest_ids.join(p, "cluster_id").select(F.col("_newest_id").alias("id"), "_p", "_pf")
    updated = analyses.join(hit, "id", "left").select(*[
        F.when(F.col("_p").isNotNull(), F.col("_p")).otherwise(F.col("patch")).alias("patch")
        if c == "patch" else
        F.when(F.col("_p").isNotNull(), F.col("_pf")).otherwise(F.col("patch_file_name"))
        .alias("patch_file_name") if c == "patch_file_name" else F.col(c)
        for c in analyses.columns])
    orphan = patches.join(analyses.select("cluster_id"), "cluster_id", "left_anti")
    added = orphan.select(*[
        F.concat(F.col("cluster_id"), F.lit("#patch")).alias("id") if c == "id" else
        F.col(c) if c in ("cluster_id", "patch", "patch_file_name", "created_at") else
        F.lit("MEDIUM").alias(c) if c == "confidence" else
        F.lit(None).cast(analyses.schema[c].dataType).alias(c)
        for c in analyses.columns])
    return updated.unionByName(added)


# ---------------------------------------------------------------- snapshots

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _versions(spark: SparkSession, base: str, kind: str = "v") -> list[int]:
    """Numbers of the complete folders ``base/<kind>=NNNNNN``, ascending."""
    fs, p, jvm = _fs(spark, base)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(n[len(kind) + 1:]) for n in names if n.startswith(f"{kind}=")
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(p, f"{n}/_SUCCESS")))


def _folder(base: str, kind: str, version: int) -> str:
    return f"{base.rstrip('/')}/{kind}={version:06d}"


def latest_version(spark: SparkSession, base: str) -> int | None:
    """Newest complete version folder ``base/v=NNNNNN`` (has ``_SUCCESS``)."""
    versions = _versions(spark, base)
    return versions[-1] if versions else None


def read_snapshot(spark: SparkSession, base: str) -> DataFrame | None:
    v = latest_version(spark, base)
    return None if v is None else spark.read.parquet(f"{base.rstrip('/')}/v={v:06d}")


def write_snapshot(df: DataFrame, base: str) -> str:
    """Write ``df`` as the next version; readers switch when it is complete
    (``_SUCCESS`` written). A version left incomplete by a failed job is
    never read and is simply written again."""
    spark = df.sparkSession
    v = (latest_version(spark, base) or 0) + 1
    path = f"{base.rstrip('/')}/v={v:06d}"
    df.write.mode("overwrite").parquet(path)
    return path


# ---------------------------------------------------------------- changes

def write_changes(changed: DataFrame, base: str, version: int, key: list[str] | None = None,
                  fold_every: int = 20, keep: int = 2) -> bool:
    """Write the changed rows of a keyed table as ``base/d=NNNNNN``; False
    when that version is there already (a replayed batch).

    Every ``fold_every`` versions the changes are folded into a whole
    snapshot; the last ``keep`` snapshots stay with the changes after the
    older of them, all before that is deleted. So the folders to list and
    read are bounded, and a reader has a whole fold cycle to finish."""
    spark = changed.sparkSession
    folded = _versions(spark, base)
    newest = max([*folded[-1:], *_versions(spark, base, "d")[-1:]], default=0)
    if newest < version:
        changed.write.mode("overwrite").parquet(_folder(base, "d", version))
    if version % fold_every == 0 and version not in folded:  # also after a stop between change and fold
        read_changes(spark, base, key).write.mode("overwrite").parquet(_folder(base, "v", version))
        folded = _versions(spark, base)
        fs, _, jvm = _fs(spark, base)
        first = folded[-keep:][0]
        for kind, limit in (("v", first), ("d", first + 1)):
            for old in _versions(spark, base, kind):
                if old < limit:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(_folder(base, kind, old)), True)
    return newest < version


def read_changes(spark: SparkSession, base: str, key: list[str] | None = None) -> DataFrame | None:
    """The table that `write_changes` keeps: of every ``key`` the row of the
    newest version, over the newest snapshot and the changes after it."""
    key = KEY if key is None else key
    whole = latest_version(spark, base)
    parts = [] if whole is None else [(whole, _folder(base, "v", whole))]
    parts += [(d, _folder(base, "d", d)) for d in _versions(spark, base, "d") if d > (whole or 0)]
    if not parts:
        return None
    rows = None
    for version, path in parts:
        one = spark.read.parquet(path).withColumn("_version", F.lit(version))
        rows = one if rows is None else rows.unionByName(one)
    names = [c for c in rows.columns if c != "_version"]
    if len(parts) == 1:
        return rows.select(*names)
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*names), "_version").alias("_r"))
    return newest.select("_r.*")


# ---------------------------------------------------------------- state by application

def app_folder(base: str, app_id: str) -> str:
    """The folder of one application's state: any id makes a safe name."""
    return f"{base.rstrip('/')}/app=s{app_id.encode().hex()}"


def write_app_changes(state: DataFrame, scan: DataFrame, app_id: str, base: str, asof) -> str:
    """Upsert the clusters of one application's scan (U1) into its own folder
    and return the folder.

    The first time all rows that ``state`` has of the application are written;
    later only the rows that the scan saw, over what the folder holds then
    (``state`` isn't read any more). Other applications' rows are neither read nor
    written, so scans of different applications can run at once; of one
    application one at a time. An empty scan writes an empty change."""
    spark, folder = scan.sparkSession, app_folder(base, app_id)
    held = read_changes(spark, folder)
    if held is None:
        changed = upsert_clusters(state.where(F.col("app_id") == app_id), scan, asof)
    else:
        seen = held.join(scan.select(*KEY), KEY, "left_semi")
        changed = upsert_clusters(seen, scan, asof)
    newest = max([0, *_versions(spark, folder)[-1:], *_versions(spark, folder, "d")[-1:]])
    write_changes(changed, folder, newest + 1)
    return folder


def read_app_states(spark: SparkSession, base: str, initial: DataFrame | None = None) -> DataFrame | None:
    """The state of all applications that `write_app_changes` keeps under
    ``base``, and the rows of ``initial`` of those that have no folder yet. None
    if there is neither. Snapshots and changes are two reads whatever the number
    of applications."""
    fs, p, _ = _fs(spark, base)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    paths, apps = {"v": [], "d": []}, []
    for name in sorted(n for n in names if n.startswith("app=s")):
        folder = f"{base.rstrip('/')}/{name}"
        whole = (_versions(spark, folder)[-1:] or [0])[0]
        changes = [d for d in _versions(spark, folder, "d") if d > whole]
        if whole or changes:
            apps.append((bytes.fromhex(name[len("app=s"):]).decode(),))
            paths["v"] += [_folder(folder, "v", whole)] if whole else []
            paths["d"] += [_folder(folder, "d", d) for d in changes]
    if not apps:
        return initial
    rows = None
    for kind, found in paths.items():
        if found:
            one = spark.read.option("basePath", base).parquet(*found).withColumn("_version", F.col(kind).cast("long")).drop(kind, "app")
            rows = one if rows is None else rows.unionByName(one)
    names = [c for c in rows.columns if c != "_version"]
    out = rows.groupBy(*KEY).agg(F.max_by(F.struct(*names), "_version").alias("_r")).select("_r.*")
    if initial is None:
        return out
    rest = initial.join(spark.createDataFrame(apps, "app_id string"), "app_id", "left_anti")
    return out.unionByName(rest.select(*names))
