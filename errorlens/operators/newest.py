"""Newest rows of the stored log table (T1, T2, T5, J6) without reading it.

The table has one folder for each ``log_date``, and a row's day never
decreases with its time. So the newest rows are in the newest folders: folders
are opened from the newest back, 1, 2, 4, ... days more at a time, until
enough rows are there; every folder that was not opened holds older rows only.
Only folder names go through the driver, and one number a round.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errorlens.functions.levels import is_error
from errorlens.operators.filters import newest_first
from errorlens.operators.tenants import newest_per
from errorlens.session import checkpoint
from errorlens.sources.logs import day_folders, to_log_schema


def _days(spark: SparkSession, path: str, days: list[str]) -> DataFrame:
    df = spark.read.option("basePath", path).parquet(*[f"{path}/log_date={d}" for d in days])
    return to_log_schema(df, keep=["log_date"])


def _rounds(days: list[str]) -> Iterator[list[str]]:
    """The days in groups of 1, 2, 4, ..."""
    at, size = 0, 1
    while at < len(days):
        yield days[at:at + size]
        at, size = at + size, 2 * size


def newest_stored(spark: SparkSession, path: str, n: int, where: Column | None = None) -> DataFrame:
    """The newest ``n`` rows (time, then id, descending) that ``where`` takes,
    of the table that `write_logs` wrote to ``path``. Fewer if the table has
    fewer. Days with no such rows only cost the look into them."""
    path, taken, found = path.rstrip("/"), [], 0
    days = day_folders(spark, path)
    chosen = lambda ds: _days(spark, path, ds) if where is None else _days(spark, path, ds).filter(where)
    for more in _rounds(days):
        taken += more
        found += chosen(more).limit(n - found).count()
        if found >= n:
            break
    if not taken:
        return to_log_schema(spark.createDataFrame([], "id long")).withColumn("log_date", F.lit(None).cast("date"))
    return newest_first(chosen(taken)).limit(n)


def recent_stored(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """T2 on the stored table."""
    return newest_stored(spark, path, n)


def by_level_stored(spark: SparkSession, path: str, level: str, n: int = 100) -> DataFrame:
    """T1 on the stored table."""
    return newest_stored(spark, path, n, F.col("level") == level.upper())


def capped_scan_stored(spark: SparkSession, path: str, n: int) -> DataFrame:
    """T5 on the stored table: the newest ``n`` error rows."""
    return newest_stored(spark, path, n, is_error("level"))


def latest_error_per_app_stored(spark: SparkSession, path: str, apps: DataFrame) -> DataFrame:
    """J6 on the stored table: the newest error row of each of ``apps``
    (``app_id``). A round looks for the applications not found yet; an
    application without errors is looked for in all days. Null ids match
    nothing."""
    path, found = path.rstrip("/"), None
    left = checkpoint(apps.select("app_id").where("app_id is not null").distinct())
    for days in _rounds(day_folders(spark, path)):
        rows = _days(spark, path, days).filter(is_error("level")).join(left, "app_id", "left_semi")
        got = checkpoint(newest_per(rows, "app_id", order=("timestamp", "id")))
        found = got if found is None else found.unionByName(got)
        left = checkpoint(left.join(got.select("app_id"), "app_id", "left_anti"))
        if left.isEmpty():
            break
    if found is None:
        return to_log_schema(spark.createDataFrame([], "id long")).withColumn("log_date", F.lit(None).cast("date"))
    return found
