"""Scans that write their own application's state only."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from errorlens.operators import filters as FL
from errorlens.operators.state import app_folder, read_app_states, read_changes
from errorlens.plans.scan import cloud_scan, run_cloud_scan

D = "/root/testdata/sf0.001"
COLS = ["app_id", "id", "fingerprint", "occurrence_count", "status"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_scans_of_two_apps_keep_each_others_rows(spark, tmp_path):
    lg, st = E.logs(spark, D), E.state(spark, D)
    asof, base = FL.asof_of(lg), f"{tmp_path}/state"
    assert rows(read_app_states(spark, base, st)) == rows(st)            # nothing scanned yet
    want = {a: rows(cloud_scan(lg, st, a, asof, hours=240)["state"]) for a in ("app-1", "app-2")}
    # both start from the same state, as two scans at once do
    for app in want:
        run_cloud_scan(lg, st, app, asof, base, hours=240, per_app=True)
    others = rows(st.where(~F.col("app_id").isin(list(want))))
    assert rows(read_app_states(spark, base, st)) == sorted(want["app-1"] + want["app-2"] + others)
    assert rows(read_app_states(spark, base)) == sorted(want["app-1"] + want["app-2"])


def test_a_later_scan_writes_only_what_it_saw(spark, tmp_path):
    lg, st = E.logs(spark, D), E.state(spark, D)
    asof, base = FL.asof_of(lg), f"{tmp_path}/state"
    run_cloud_scan(lg, st, "app-1", asof, base, hours=240, per_app=True)
    before = {r["fingerprint"]: r for r in read_changes(spark, app_folder(base, "app-1")).collect()}
    few = lg.where("app_id = 'app-1' and level in ('ERROR', 'FATAL')").limit(1)
    run_cloud_scan(few, st, "app-1", asof, base, hours=24 * 365, per_app=True)
    written = spark.read.parquet(f"{app_folder(base, 'app-1')}/d=000002").collect()
    assert len(written) == 1 and written[0]["occurrence_count"] == 1
    after = {r["fingerprint"]: r for r in read_app_states(spark, base).collect()}
    changed = written[0]["fingerprint"]
    assert after[changed]["occurrence_count"] == 1
    assert {k: r["occurrence_count"] for k, r in after.items() if k != changed} == {
        k: r["occurrence_count"] for k, r in before.items() if k != changed}
    run_cloud_scan(lg.where("false"), st, "app-1", asof, base, per_app=True)   # no errors: nothing changes
    assert len(read_app_states(spark, base).collect()) == len(after)
    assert sorted(os.listdir(base)) == [os.path.basename(app_folder(base, "app-1"))]
