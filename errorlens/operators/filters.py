"""Row filters and simple lookups over a log table.

Filters keep ``timestamp`` and ``level`` bare so Catalyst pushes them into
the Parquet scan (and prunes ``log_date`` partitions when the table is laid
out by date). Time bounds may be Python values or Columns (for example a
scalar subquery such as ``max(timestamp)``), so no wall clock is read.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorlens.functions.levels import at_least, is_error
from errorlens.functions.mdc import parse_mdc
from errorlens.functions.text import parse_lookback
from errorlens.functions.traces import outer_frames

TS = "timestamp"


def ts_value(df: DataFrame, value, col: str = TS) -> Column:
    """A time bound typed like ``df[col]`` (timestamp or timestamp_ntz)."""
    dtype = df.schema[col].dataType.simpleString()
    c = value if isinstance(value, Column) else F.lit(
        value.isoformat(sep=" ") if isinstance(value, datetime) else value)
    return c.cast(dtype)


def asof_of(df: DataFrame, col: str = TS) -> Column:
    """The newest timestamp of a table as a literal typed like the column.

    One small aggregate job; the value comes back as text formatted in the
    session time zone and is cast back the same way. A literal (unlike a
    scalar subquery, which the plan would evaluate once per use) lets time
    filters prune ``log_date`` folders when the query is planned and push
    down to the scan.
    """
    value = df.agg(F.max(col).cast("string")).first()[0]
    return F.lit(value).cast(df.schema[col].dataType)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc(TS), F.desc("id"))


def with_min_level(df: DataFrame, threshold: str = "WARN") -> DataFrame:
    """Rows whose canonical level ranks at or above ``threshold``."""
    return df.filter(at_least("level", threshold))


def errors(df: DataFrame) -> DataFrame:
    """ERROR and FATAL rows."""
    return df.filter(is_error("level"))


def _day_bounds(df: DataFrame, start: Column | None, end: Column | None) -> Column:
    """The same bounds on ``log_date``, so a day-partitioned table prunes
    whole folders (Spark does not derive partition filters from the
    timestamp). The timestamp test stays; this one only skips folders."""
    cond = F.lit(True)
    if "log_date" not in df.columns:
        return cond
    day = F.col("log_date")
    if start is not None:
        cond = cond & (day >= F.to_date(start))
    if end is not None:
        cond = cond & (day <= F.to_date(end))
    return cond


def in_range(df: DataFrame, start, end, ordered: bool = False) -> DataFrame:
    """``start <= timestamp <= end``; newest first when ``ordered``."""
    lo, hi = ts_value(df, start), ts_value(df, end)
    out = df.filter(_day_bounds(df, lo, hi) & (F.col(TS) >= lo) & (F.col(TS) <= hi))
    return newest_first(out) if ordered else out


def since(df: DataFrame, asof, hours: float = 24) -> DataFrame:
    """P5 (cloud): ``timestamp >= asof - hours``, no upper end."""
    lower = ts_value(df, asof) - F.make_dt_interval(secs=F.lit(float(hours) * 3600.0))
    return df.filter(_day_bounds(df, lower, None) & (F.col(TS) >= lower))


def in_last(df: DataFrame, asof, lookback: str | None, default: timedelta = timedelta(hours=24),
            ordered: bool = False) -> DataFrame:
    """P4 over the text lookback ``(\\d+)([smhd])`` ending at ``asof``.
    Unparseable text falls back to ``default`` (1 h for a scan, 24 h for
    cluster lists and reports)."""
    span = parse_lookback(lookback, default)
    end = ts_value(df, asof)
    start = end - F.make_dt_interval(secs=F.lit(span.total_seconds()))
    return in_range(df, start, end, ordered)


def errors_in_range(df: DataFrame, start, end, ordered: bool = False) -> DataFrame:
    """P3 and P4 together."""
    return in_range(errors(df), start, end, ordered)


def for_app(df: DataFrame, app_id: str) -> DataFrame:
    """One application's rows."""
    return df.filter(F.col("app_id") == app_id)


def entry_location(df: DataFrame) -> Column:
    """P10: ``class.method`` when both are present, else the class."""
    c, m = F.col("class_name"), F.col("method_name")
    return F.when(c.isNotNull() & m.isNotNull(), F.concat(c, F.lit("."), m)).otherwise(c)


def cluster_location(prefix: str = "primary_") -> Column:
    """``class`` + ``.method`` + ``:line`` of a cluster, each part only
    if present; empty text if none."""
    from errorlens.functions.fingerprints import location_key
    return location_key(f"{prefix}class", f"{prefix}method", f"{prefix}line")


def find_cluster(clusters: DataFrame, cluster_id: str) -> DataFrame:
    """The first ranked cluster whose id equals ``cluster_id``, case
    ignored."""
    from errorlens.operators.clusters import rank_clusters
    hit = clusters.filter(F.upper(F.col("cluster_id")) == cluster_id.upper())
    return rank_clusters(hit).limit(1)


# Packages skipped when the capture side looks for the first
# non-framework frame. The capture library's own package is added by the
# caller through ``extra_prefixes``.
CAPTURE_FRAMEWORK_PREFIXES = ["java.", "javax.", "sun.", "com.sun.", "jdk.",
                              "org.slf4j.", "ch.qos.logback."]


def enrich_location(df: DataFrame, variant: str = "first",
                    extra_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Fill missing class/method/file/line from the trace.

    ``first``: the first frame of the outermost exception. ``first_user``:
    its first frame outside the capture-time framework packages.
    """
    frames = outer_frames("stack_trace")
    if variant == "first":
        pick = F.try_element_at(frames, F.lit(1))
    elif variant == "first_user":
        prefixes = CAPTURE_FRAMEWORK_PREFIXES + list(extra_prefixes)
        pattern = r"\A(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"
        pick = F.try_element_at(F.filter(frames, lambda f: ~f["class_name"].rlike(pattern)), F.lit(1))
    else:
        raise ValueError("variant must be 'first' or 'first_user'")
    has = F.col("stack_trace").isNotNull() & (F.length("stack_trace") > 0)
    out = df.withColumn("_frame", F.when(has, pick))
    for col, field in (("class_name", "class_name"), ("method_name", "method_name"),
                       ("file_name", "file_name"), ("line_number", "line_number")):
        out = out.withColumn(col, F.coalesce(F.col(col), F.col("_frame")[field]))
    return out.drop("_frame")


def enrich_trace_id(df: DataFrame, mdc: str = "mdc_context") -> DataFrame:
    """``trace_id`` from the context key ``traceId`` when missing.
    Accepts the context as a map or as ``k=v;k=v`` text."""
    m = F.col(mdc)
    if df.schema[mdc].dataType.simpleString() == "string":
        m = parse_mdc(m)
    tid = F.try_element_at(m, F.lit("traceId"))
    base = F.col("trace_id") if "trace_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("trace_id", F.coalesce(base, tid))


def by_level(df: DataFrame, level: str, n: int = 100) -> DataFrame:
    """The newest ``n`` rows at one level (top-k, no full sort)."""
    return newest_first(df.filter(F.col("level") == level.upper())).limit(n)


def recent(df: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` rows."""
    return newest_first(df).limit(n)


def delete_older_than(df: DataFrame, cutoff) -> tuple[DataFrame, Column]:
    """Rows with ``timestamp >= cutoff`` and, as a scalar subquery, how
    many rows were dropped (strictly older than ``cutoff``)."""
    bound = ts_value(df, cutoff)
    kept = df.filter(F.col(TS) >= bound)
    dropped = df.filter(F.col(TS) < bound).select(F.count(F.lit(1))).scalar()
    return kept, dropped

