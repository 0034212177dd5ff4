"""Error clustering (A2, A3), ranking (T3-T5) and samples.

One shuffle: error rows are fingerprinted map-side, then an aggregate
with partial (map-side) aggregation groups them. Every per-cluster pick
("the newest row that ...") is a ``max_by`` over the order key
``(timestamp, id)``, which is partial-aggregatable, so a hot fingerprint
holding a third of all rows is reduced to one buffer per map task before
the shuffle. Only narrow columns reach the aggregate: the fingerprint, the
order key, the message and the first line of the trace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errorlens.functions.fingerprints import cluster_id, fingerprint
from errorlens.functions.levels import is_error
from errorlens.functions.templates import normalize_message
from errorlens.functions.traces import class_of_head_line, exception_head_line
from errorlens.operators.sizes import broadcast_if_small
from errorlens.session import checkpoint

ORDER_KEY = ("timestamp", "id")


def severity(count) -> Column:
    """A3: grade of a cluster from its occurrence count."""
    c = F.col(count) if isinstance(count, str) else count
    return (F.when(c >= 100, F.lit("CRITICAL")).when(c >= 50, F.lit("HIGH"))
            .when(c >= 10, F.lit("MEDIUM")).otherwise(F.lit("LOW")))


def _keys(mode: str, by: Sequence[str] | None) -> list[str]:
    if by is not None:
        return list(by)
    return [] if mode == "core" else ["app_id"]


def with_fingerprint(logs: DataFrame, mode: str = "core", frames: int = 5,
                     errors_only: bool = True) -> DataFrame:
    """Error rows with their ``fingerprint`` column (F6 over a table)."""
    df = logs.filter(is_error("level")) if errors_only else logs
    return df.withColumn("fingerprint", fingerprint(mode, frames))


def cluster_errors(logs: DataFrame, mode: str = "core", frames: int = 5,
                   by: Sequence[str] | None = None, with_newest_id: bool = False) -> DataFrame:
    """A2: one row per fingerprint of the ERROR/FATAL rows of ``logs``.

    ``logs`` has canonical levels (see ``normalize_level``). ``by`` adds
    grouping keys in front of the fingerprint; default none in core mode,
    ``app_id`` in cloud mode.

    Attributes follow the mode. core: pattern from the newest row, class
    from the newest row with a trace, location from the newest row with a
    file name. cloud: all from the newest row. ``with_newest_id`` adds the
    id of the newest row (see ``newest_entries``).
    """
    keys = _keys(mode, by)
    order = F.struct(*[F.col(c) for c in ORDER_KEY])
    rows = cluster_rows(logs, keys, mode, frames)
    loc = F.struct("file_name", "line_number", "method_name", "class_name")
    if mode == "core":
        head = F.max_by("_head", F.when(F.col("_head").isNotNull(), order))
        where = F.max_by(loc, F.when(F.col("file_name").isNotNull(), order))
    else:
        head = F.max_by("_head", order)
        where = F.max_by(loc, order)
    agg = rows.groupBy(*keys, "fingerprint").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.max_by("message", order).alias("_message"),
        head.alias("_head"),
        where.alias("_loc"),
        *([F.max_by("id", order).alias("newest_id")] if with_newest_id else []),
    )
    return clusters_of(agg, keys, mode, ["newest_id"] if with_newest_id else [])


def cluster_rows(logs: DataFrame, keys: Sequence[str], mode: str = "core", frames: int = 5) -> DataFrame:
    """The narrow error rows that a clustering aggregates: the keys, the
    fingerprint, the order key, the message, the trace's first line (`_head`)
    and the location."""
    narrow = logs.filter(is_error("level")).select(
        *keys, "timestamp", "id", "message", "stack_trace",
        "file_name", "line_number", "method_name", "class_name")
    return with_fingerprint(narrow, mode, frames, errors_only=False).select(
        *keys, "fingerprint", "timestamp", "id", "message",
        exception_head_line("stack_trace", mode).alias("_head"),
        "file_name", "line_number", "method_name", "class_name")


def clusters_of(agg: DataFrame, keys: Sequence[str], mode: str = "core", more: Sequence[str] = ()) -> DataFrame:
    """Cluster rows from the aggregates of their error rows."""
    return agg.select(
        *keys,
        cluster_id("fingerprint").alias("cluster_id"),
        "fingerprint",
        class_of_head_line("_head", mode).alias("exception_class"),
        normalize_message("_message", mode).alias("message_pattern"),
        F.col("_loc.file_name").alias("primary_file"),
        F.col("_loc.line_number").alias("primary_line"),
        F.col("_loc.method_name").alias("primary_method"),
        F.col("_loc.class_name").alias("primary_class"),
        "first_seen", "last_seen", "occurrence_count",
        severity("occurrence_count").alias("severity"),
        *more,
    )


def fetch_rows(ids: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of a large table for a few ids. The ids are written once and
    their bytes added up: where they fit a broadcast, the table is read in place
    and never shuffled; more of them are joined by shuffle."""
    return rows.join(broadcast_if_small(checkpoint(ids)), list(on))


def newest_entries(logs: DataFrame, clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """W2 from a cluster table made ``with_newest_id``: the newest row of
    each cluster, read from the log table by id (a join with one row per
    cluster, so traces are neither parsed again nor shuffled)."""
    ids = clusters.select(*by, "fingerprint", F.col("newest_id").alias("id"))
    return fetch_rows(ids, logs.filter(is_error("level")).drop("fingerprint"), [*by, "id"])


def rank_clusters(clusters: DataFrame) -> DataFrame:
    """Most frequent first; ties by newest last sighting, then
    fingerprint, so the order does not depend on partitioning."""
    return clusters.orderBy(F.desc("occurrence_count"), F.desc("last_seen"), F.asc("fingerprint"))


def top_clusters(clusters: DataFrame, n: int = 10, materialize: bool = True) -> DataFrame:
    """T4: the first ``n`` ranked clusters, each with ``remaining``, the
    number of clusters not shown. Top-k (no global sort); the total is a
    scalar subquery, not a join. The cluster table is read twice (top-k and
    count), so with ``materialize`` it is checkpointed once first and the
    clustering of the log rows runs once."""
    if materialize:
        clusters = checkpoint(clusters)
    total = clusters.select(F.count(F.lit(1))).scalar()
    top = rank_clusters(clusters).limit(n)
    return top.withColumn("remaining", F.greatest(total - F.lit(n), F.lit(0)).cast("bigint"))


def capped_scan(logs: DataFrame, n: int = 1000) -> DataFrame:
    """T5: only the newest ``n`` error rows (cloud parity; off by default)."""
    return logs.filter(is_error("level")).orderBy(
        F.desc("timestamp"), F.desc("id")).limit(n)


def most_recent_entry(fingerprinted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The newest row of each cluster. The newest id per cluster is an
    aggregate over narrow columns; the rest of the row is joined back by id
    (the table's key) from the same rows without their fingerprint, so the
    trace parsing behind the fingerprint runs once."""
    order = F.struct(*[F.col(c) for c in ORDER_KEY])
    ids = fingerprinted.groupBy(*by, "fingerprint").agg(F.max_by("id", order).alias("id"))
    rest = [c for c in fingerprinted.columns if c not in (*by, "fingerprint", "id")]
    if not rest:
        return ids.join(fingerprinted.select(*by, "fingerprint", "id"), [*by, "fingerprint", "id"])
    return fetch_rows(ids, fingerprinted.select("id", *rest), ["id"])


def sample_positions(n: Column, k: int) -> Column:
    """Sampled positions (0-based, newest first) of a cluster of ``n`` rows:
    all when ``n <= k``, else 0, ``i * (n div (k-1))`` for i in 1..k-2,
    and n-1."""
    step = F.floor(n / (k - 1)).cast("bigint")
    spaced = F.array(F.lit(0).cast("bigint"), *[(step * i).cast("bigint") for i in range(1, k - 1)],
                     (n - 1).cast("bigint"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"))).otherwise(
        F.array_distinct(spaced))


def sample_entries(fingerprinted: DataFrame, k: int = 3, by: Sequence[str] = (),
                   bucket_seconds: int = 1, materialize: bool = True) -> DataFrame:
    """Evenly spaced samples of each cluster (positions newest first,
    see ``sample_positions``), with ``sample_index`` and the cluster size
    ``n``.

    ``id`` is the row key of the table. Skew-safe: rows are counted per
    cluster and per time bucket (an aggregate with map-side partial counts,
    so a cluster holding a third of all rows is no problem); running counts
    over the buckets of a cluster tell which buckets hold the sampled
    positions; only the rows of those few buckets are ranked, each bucket in
    its own window partition.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    keys = [*by, "fingerprint"]
    b = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / (bucket_seconds * 1_000_000)).alias("_b")
    # the rows are read twice (counts, then the sampled buckets): keep only
    # the narrow key columns, written once, so fingerprints are computed once
    narrow = fingerprinted.select(*keys, "timestamp", "id")
    if materialize:
        narrow = checkpoint(narrow)
    rows = narrow.withColumn("_b", b)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w_all = Window.partitionBy(*keys)
    w_run = w_all.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.select(*keys, "_b", "_c", F.coalesce(F.sum("_c").over(w_run), F.lit(0)).alias("_before"),
                        F.sum("_c").over(w_all).alias("n"))
    hit = cum.withColumn("_targets", F.filter(
        sample_positions(F.col("n"), k),
        lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_c")))).filter(F.size("_targets") > 0)
    picked = rows.join(hit.select(*keys, "_b", "_before", "n", "_targets"), [*keys, "_b"])
    w_local = Window.partitionBy(*keys, "_b").orderBy(F.desc("timestamp"), F.desc("id"))
    ranked = picked.withColumn("sample_index", F.col("_before") + F.row_number().over(w_local) - 1)
    sampled = (ranked.filter(F.array_contains("_targets", F.col("sample_index")))
               .select(*keys, "id", "sample_index", "n"))
    # the other columns of the sampled rows, by their id (the table's key);
    # dropping the fingerprint lets the scan skip the trace parsing
    rest = [c for c in fingerprinted.columns if c not in (*keys, "id")]
    if not rest:
        return sampled
    return fetch_rows(sampled, fingerprinted.select("id", *rest), ["id"])
