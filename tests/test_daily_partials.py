"""Clusters and report figures from daily partials equal the full scan."""

import os
import random
from datetime import datetime

from pyspark.sql import functions as F

from errorlens.operators import clusters as C
from errorlens.operators import daily as D
from errorlens.operators import report as R
from errorlens.sources.logs import delete_older_than_on_disk, read_logs, write_logs

ROWS = ("id long, app_id string, timestamp timestamp, level string, message string, stack_trace string, "
        "file_name string, line_number int")
TRACES = [None, "java.lang.IllegalStateException: no\n\tat com.acme.A.run(A.java:10)",
          "com.acme.Broken: x\n\tat com.acme.B.go(B.java:7)\nCaused by: java.io.IOException: y\n\tat com.acme.C.read(C.java:3)"]


def rows(rng, n, first, days):
    return [(first + i, rng.choice(["a", "b", None]),
             datetime(2024, 1, rng.choice(days), rng.randint(0, 23), rng.randint(0, 1)),
             rng.choice(["INFO", "ERROR", "FATAL", "WARN"]), rng.choice(["order 17 lost", "disk full", None, "order 18 lost"]),
             rng.choice(TRACES), rng.choice([None, "A.java", "B.java"]), rng.randint(1, 3)) for i in range(n)]


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, a.select(*b.columns).collect())) == sorted(map(key, b.collect()))


def check(spark, logs_path, bases, first=None, last=None):
    lg = read_logs(spark, logs_path)
    if first:
        lg = lg.where(F.col("log_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    apps = spark.createDataFrame([("a",), ("b",), ("none",)], "app_id string")
    for mode, base in bases.items():
        levels, clusters = D.read_partials(spark, base, first, last, mode)
        merged, full = D.merge_cluster_partials(clusters, mode), C.cluster_errors(lg, mode=mode)
        same(merged, full)
        same(D.merge_level_partials(levels), R.count_by_level(lg))
        same(D.summary_of_partials(levels, merged), R.report_summary(lg, full))
        if mode == "cloud":
            same(D.app_stats_of_partials(levels, merged, apps), R.app_stats(lg, full, apps))


def test_partials_follow_appends_late_rows_and_retention(spark, tmp_path):
    rng = random.Random(11)
    path, bases = f"{tmp_path}/logs", {"core": f"{tmp_path}/core", "cloud": f"{tmp_path}/cloud"}

    def refresh():
        found = {tuple(D.refresh_partials(spark, path, base, mode)) for mode, base in bases.items()}
        assert len(found) == 1
        return list(found.pop())

    assert refresh() == []                                            # no table yet
    write_logs(spark.createDataFrame(rows(rng, 300, 0, [3, 4, 5, 6]), ROWS), path)
    assert refresh() == [f"2024-01-0{d}" for d in (3, 4, 5, 6)]
    check(spark, path, bases)
    assert refresh() == []                                            # nothing changed
    late = rows(rng, 40, 1000, [4, 9])
    late += late[:3]                                                  # repeated rows
    write_logs(spark.createDataFrame(late, ROWS), path)
    assert refresh() == ["2024-01-04", "2024-01-09"]                  # the late day and the new one only
    check(spark, path, bases)
    check(spark, path, bases, "2024-01-04", "2024-01-05")
    delete_older_than_on_disk(spark, path, "2024-01-05 12:00:00")
    assert refresh() == ["2024-01-05"]                                # the cutoff's day; two days are gone
    check(spark, path, bases)


def test_a_days_partial_is_read_without_the_others_or_the_log(spark, tmp_path):
    rng = random.Random(5)
    path, base = f"{tmp_path}/logs", f"{tmp_path}/p"
    write_logs(spark.createDataFrame(rows(rng, 200, 0, [1, 2, 3]), ROWS), path)
    D.refresh_partials(spark, path, base)
    _, clusters = D.read_partials(spark, base, "2024-01-02", "2024-01-02")
    assert clusters.select("log_date").distinct().count() == 1
    plan = clusters._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and path not in plan


def test_days_without_errors_and_a_stopped_job(spark, tmp_path):
    path, base = f"{tmp_path}/logs", f"{tmp_path}/p"
    quiet = [(1, "a", datetime(2024, 1, 1), "INFO", "m", None, None, None)]
    write_logs(spark.createDataFrame(quiet, ROWS), path)
    assert D.refresh_partials(spark, path, base) == ["2024-01-01"]
    check(spark, path, {"core": base})
    # a batch that no list of days names: a job stopped before its last step
    os.makedirs(f"{base}/clusters/b=xstopped/log_date=2024-01-01")
    levels, _ = D.read_partials(spark, base)
    levels.withColumn("count", F.lit(99).cast("long")).drop("log_date").write.parquet(f"{base}/levels/b=xstopped/log_date=2024-01-01")
    check(spark, path, {"core": base})
    noisy = [(2, "a", datetime(2024, 1, 2), "ERROR", "m", TRACES[1], "A.java", 3)]
    write_logs(spark.createDataFrame(noisy, ROWS), path)
    assert D.refresh_partials(spark, path, base) == ["2024-01-02"]
    assert not os.path.exists(f"{base}/levels/b=xstopped")
    check(spark, path, {"core": base})


def test_a_table_never_refreshed_is_empty(spark, tmp_path):
    levels, clusters = D.read_partials(spark, f"{tmp_path}/none")
    summary = D.summary_of_partials(levels, D.merge_cluster_partials(clusters)).first()
    assert summary.asDict() == {"total_logs": 0, "error_logs": 0, "error_rate": 0.0, "cluster_count": 0,
                                "critical_count": 0, "high_count": 0}
