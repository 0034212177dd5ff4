"""Code context of a class written for this test, sources read from disk, and
stream results equal to batch."""

import os
import tempfile

from pyspark.sql import functions as F

from errorlens.operators.context import code_context, format_context, read_sources

# Line 21 adds up the sum; the method runs from line 15 to 24.
SOURCE = """package shop.billing;

import java.time.Clock;
import java.util.Map;

/** Adds up what a basket costs. */
final class PriceBook {
    private final Map<String, Long> cents;
    private static final int LIMIT = 99;

    PriceBook(Map<String, Long> cents) {
        this.cents = cents;
    }

    long total(Iterable<String> basket) {
        long sum = 0;
        for (String item : basket) {
            if (sum > LIMIT) {
                break;
            }
            sum += cents.get(item);
        }
        return sum;
    }

    Clock clock() { return Clock.systemUTC(); }
}
"""


def test_code_context_of_a_class(spark):
    root = tempfile.mkdtemp(prefix="errorlens-src-")
    os.makedirs(os.path.join(root, "shop", "billing"))
    with open(os.path.join(root, "shop", "billing", "PriceBook.java"), "w") as f:
        f.write(SOURCE)
    sources = read_sources(spark, [root])
    assert sources.select("rel_path").first().rel_path == "shop/billing/PriceBook.java"
    places = "fingerprint string, primary_class string, primary_line int, primary_file string"
    at = lambda line: spark.createDataFrame([("fp", "shop.billing.PriceBook", line, "PriceBook.java")], places)
    ctx = format_context(code_context(at(21), sources)).first()
    assert (ctx.class_name, ctx.method_name) == ("PriceBook", "total")
    assert (ctx.method_start, ctx.method_end) == (15, 24)
    assert (ctx.start_line, ctx.end_line) == (11, 27)
    assert ctx.imports == ["import java.time.Clock;", "import java.util.Map;"]
    assert ctx.class_fields == ["private final Map<String, Long> cents;", "private static final int LIMIT = 99;"]
    assert ctx.method_body == "\n".join(SOURCE.split("\n")[14:24]) + "\n"
    assert " >>>   21 | " in ctx.formatted_context
    assert code_context(at(21), sources, match="file").first().method_name == "total"
    one_line = code_context(at(26), sources).first()
    assert (one_line.method_name, one_line.method_start, one_line.method_end) == ("clock", 26, 26)
    assert code_context(at(99), sources).count() == 0


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    d = "/root/testdata/sf0.001"
    streamed = E.q_stream_clusters(spark, d)
    batch = E.q_clusters_cloud(spark, d).withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz")) \
        .withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))
    cols = sorted(batch.columns)
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_write_read_and_retention_on_disk(spark):
    import tempfile
    from errorlens.sources.logs import delete_older_than_on_disk, read_logs, to_log_schema, write_logs
    from fixtures_ref import frame
    path = tempfile.mkdtemp(prefix="errorlens-logs-") + "/t"
    write_logs(to_log_schema(frame(spark)), path)
    back = read_logs(spark, path)
    assert back.count() == 17
    cutoff = "2024-03-01 11:55:00"
    dropped = delete_older_than_on_disk(spark, path, cutoff)
    left = read_logs(spark, path)
    assert dropped + left.count() == 17
    assert left.filter(F.col("timestamp") < F.lit(cutoff).cast("timestamp")).count() == 0


def test_text_logs_split_across_tasks(spark):
    """Records that cross split borders are rebuilt the same as whole files."""
    import __spark_entry__ as E
    from errorlens.sources.logs import read_log_files
    d = "/root/testdata/sf0.001"
    path = E._log_files(spark, d)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        lines = read_log_files(spark, path, how="lines")
        assert spark.read.text(path).rdd.getNumPartitions() > 4  # files really are split
        cols = ["timestamp", "thread_name", "level", "logger", "message", "stack_trace"]
        got = sorted(map(tuple, lines.select(cols).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = sorted(map(tuple, read_log_files(spark, path, whole_files=True).select(cols).collect()), key=repr)
    assert len(got) == 1000 and got == whole


def test_json_rows_mapping(spark):
    from errorlens.sources.logs import from_json_rows
    rows = [('{"id": 1, "app_id": "a", "timestamp": "2024-01-02T03:04:05.678Z", "level": "warning", '
             '"message": "m", "mdc_context": {"traceId": "t1"}}',),
            ('{"id": 2, "app_id": "a", "timestamp": "2024-01-02T03:04:06Z", "level": null}',)]
    df = from_json_rows(spark.createDataFrame(rows, "value string"))
    got = df.select("id", "level", "mdc_context", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("t")).collect()
    assert [(r.id, r.level) for r in got] == [(1, "WARN"), (2, "INFO")]
    assert got[0].mdc_context == {"traceId": "t1"} and got[0].t == "2024-01-02 03:04:05.678"


def test_run_cloud_scan_observes_counts(spark):
    import tempfile
    import __spark_entry__ as E
    from errorlens.operators import filters as FL
    from errorlens.operators.state import read_snapshot
    from errorlens.plans.scan import cloud_scan, run_cloud_scan
    d = "/root/testdata/sf0.001"
    lg = E.logs(spark, d)
    st = E.state(spark, d)
    asof = FL.asof_of(lg)
    base = tempfile.mkdtemp(prefix="errorlens-state-")
    out = run_cloud_scan(lg, st, "app-1", asof, base, hours=240)
    ev = out["event"].first()
    ref = cloud_scan(lg, st, "app-1", asof, hours=240)
    want = ref["event"].first()
    assert (ev.logs_scanned, ev.errors_found, ev.clusters_created) == (
        want.logs_scanned, want.errors_found, want.clusters_created)
    snap, others = read_snapshot(spark, base), st.where("app_id <> 'app-1'")
    assert snap.where("app_id = 'app-1'").count() == ref["state"].count()
    assert snap.where("app_id <> 'app-1'").select("id").exceptAll(others.select("id")).count() == 0
    assert snap.count() == ref["state"].count() + others.count()


def test_stored_levels_are_mapped_and_bad_times_are_null(spark, tmp_path):
    from errorlens.sources.logs import read_logs, to_log_schema
    raw = spark.createDataFrame([(1, "WARNING", "2024-13-45 00:00:00"), (2, None, "2024-01-02 03:04:05")],
                                "id long, level string, timestamp string")
    back = to_log_schema(raw)
    assert [(r.id, r.level, r.timestamp is None) for r in back.orderBy("id").collect()] == [
        (1, "WARN", True), (2, "INFO", False)]
    back.withColumn("level", F.lit("SEVERE")).write.parquet(f"{tmp_path}/t")
    assert {r.level for r in read_logs(spark, f"{tmp_path}/t").collect()} == {"ERROR"}


def test_merge_keeps_counts_and_checks_its_key(spark):
    import pytest
    import __spark_entry__ as E
    from errorlens.operators.clusters import cluster_errors
    from errorlens.operators.merge import merge_similar
    lg = E.logs(spark, "/root/testdata/sf0.001")
    clusters = cluster_errors(lg, mode="cloud")
    merged = merge_similar(clusters, by=["app_id"])
    errors = lg.where("level IN ('ERROR', 'FATAL')").count()
    assert merged.agg(F.sum("occurrence_count")).first()[0] == errors
    with pytest.raises(ValueError):
        merge_similar(clusters.drop("app_id"))


def test_failed_calls_make_no_analysis(spark):
    import __spark_entry__ as E
    from errorlens.operators.clusters import cluster_errors
    from errorlens.plans.analyze import analyze
    lg = E.logs(spark, "/root/testdata/sf0.001")
    assert analyze(lg, cluster_errors(lg, "core"), lambda p: None, partitions=2).count() == 0
    cloud = cluster_errors(lg, mode="cloud", with_newest_id=True)
    rows = analyze(lg, cloud, lambda p: "EXPLANATION: x", partitions=2).collect()
    assert len(rows) == cloud.count() == len({r.id for r in rows})


def test_a_large_day_is_written_by_several_tasks(spark, tmp_path):
    import os
    from errorlens.sources.logs import to_log_schema, write_logs
    rows = spark.range(0, 200_000, 1, 16).select(
        "id", F.lit("a").alias("app_id"), F.lit("2024-01-02 03:04:05").alias("timestamp"), F.lit("INFO").alias("level"),
        F.sha2(F.col("id").cast("string"), 256).alias("message"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_logs(to_log_schema(rows), f"{tmp_path}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = [f for f in os.listdir(f"{tmp_path}/t/log_date=2024-01-02") if f.startswith("part-")]
    assert len(files) > 3 and spark.read.parquet(f"{tmp_path}/t").count() == 200_000


def test_newest_entries_do_not_shuffle_the_log(spark):
    import __spark_entry__ as E
    from errorlens.operators.clusters import cluster_errors, newest_entries
    lg = E.logs(spark, "/root/testdata/sf0.001")
    clusters = cluster_errors(lg, mode="cloud", with_newest_id=True)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = newest_entries(lg, clusters, ["app_id"])
        assert rows.count() == clusters.count()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_changes_fold_and_old_versions_go(spark, tmp_path):
    import os
    from errorlens.operators.state import read_changes, write_changes
    base, want = f"{tmp_path}/t", {}
    for version in range(1, 22):
        rows = [("a", f"f{version % 4}", version), ("b", f"g{version}", version)]
        want |= {(app, f): n for app, f, n in rows}
        df = spark.createDataFrame(rows, "app_id string, fingerprint string, n int").coalesce(1)
        assert write_changes(df, base, version, fold_every=5)
        assert not write_changes(df.withColumn("n", F.lit(-1)), base, version, fold_every=5)  # a replay
        assert len(os.listdir(base)) <= 2 + 10
    got = {(r.app_id, r.fingerprint): r.n for r in read_changes(spark, base).collect()}
    assert got == want
    assert read_changes(spark, f"{tmp_path}/none") is None


def test_scan_events_of_a_failed_scan(spark, tmp_path):
    import pytest
    import __spark_entry__ as E
    from errorlens.operators import filters as FL
    from errorlens.operators.state import scan_history
    from errorlens.plans.scan import run_cloud_scan
    lg = E.logs(spark, "/root/testdata/sf0.001")
    st, asof = E.state(spark, "/root/testdata/sf0.001"), FL.asof_of(lg)
    bad = lg.withColumn("message", F.raise_error(F.lit("broken input")).cast("string"))
    with pytest.raises(Exception, match="broken input"):
        run_cloud_scan(bad, st, "app-1", asof, f"{tmp_path}/s", hours=240, scan_id="x", events_path=f"{tmp_path}/e")
    run_cloud_scan(lg, st, "app-1", asof, f"{tmp_path}/s", hours=240, scan_id="y", events_path=f"{tmp_path}/e")
    events = spark.read.parquet(f"{tmp_path}/e")
    assert sorted((r.scan_id, r.status) for r in events.collect()) == [
        ("x", "FAILED"), ("x", "RUNNING"), ("y", "COMPLETED"), ("y", "RUNNING")]
    by_id = {r.scan_id: r for r in scan_history(events).collect()}
    assert "broken input" in by_id["x"].error_message and by_id["y"].status == "COMPLETED"


def test_rejected_log_lines_are_kept(spark, tmp_path):
    from errorlens.sources.logs import read_log_files, read_log_rejects
    head = "2024-01-01 00:00:0%d.000 [main] "
    lines = ["left over from the day before", "\tat x.Y.z(Y.java:1)",
             head % 1 + "ERROR a.B - fits", "\tat a.B.c(B.java:2)",
             head % 2 + "ERROR my logger - a space in the name", "java.lang.E: x", "\tat a.B.c(B.java:3)",
             head % 3 + "INFO  a.B no dash", "2024-13-41 00:00:00.000 [main] INFO  a.B - no such day", head % 4 + "INFO  a.B - fits too"]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("no header\nat all\n")
    for how in ("ranges", "lines", "whole"):
        taken = read_log_files(spark, str(tmp_path), how=how).collect()
        rejected = read_log_rejects(spark, str(tmp_path), how=how).collect()
        got = [x for r in rejected for x in r["text"].split("\n")]
        for r in taken:
            stamp = r["timestamp"].strftime("%Y-%m-%d %H:%M:%S.000")
            got.append(f"{stamp} [{r['thread_name']}] {r['level']:5} {r['logger']} - {r['message']}")
            got += (r["stack_trace"] or "").split("\n") if r["stack_trace"] else []
        assert sorted(got) == sorted([*lines, "no header", "at all"])
        assert sorted(r["reason"] for r in rejected) == ["date"] + ["header"] * 2 + ["leading"] * 4
