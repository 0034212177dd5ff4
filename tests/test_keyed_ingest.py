"""Keys checked inside the stream: every row in one table, once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from errorlens.operators.tenants import check_keys
from errorlens.sources.logs import read_logs
from errorlens.streaming import keyed as K

ROWS = "id long, app_id string, api_key string, timestamp timestamp, level string, message string, stack_trace string"
APPS = "app_id string, api_key string"


def batch(first, n=20):
    apps = ["a", "b", "gone", None]
    return [(first + i, apps[i % 4], ["k1", "k2", None][i % 3], datetime(2024, 1, 1 + i % 3), "ERROR" if i % 5 else "info",
             f"m{i}", None) for i in range(n)]


def test_check_keys(spark):
    apps = spark.createDataFrame([("a", "k1"), ("a", "k2"), ("a", "k1"), ("b", None), (None, "k1")], APPS)
    rows = [(1, "a", "k1"), (2, "a", "k2"), (3, "a", "x"), (4, "a", None), (5, "b", "k1"), (6, None, "k1"), (7, "c", "k1")]
    got = check_keys(spark.createDataFrame(rows, "id long, app_id string, api_key string"), apps).orderBy("id").collect()
    wrong, unknown = "wrong key", "unknown application"
    assert [(r.accepted, r.reason) for r in got] == [(True, None), (True, None), (False, wrong), (False, wrong),
                                                     (False, wrong), (False, unknown), (False, unknown)]


def test_accepted_and_rejected_are_the_input_after_stops_and_replays(spark, tmp_path, monkeypatch):
    src, good, bad, staging = (f"{tmp_path}/{x}" for x in ("src", "good", "bad", "staging"))
    keys = [("a", "k1")]
    apps = lambda: spark.createDataFrame(keys, APPS)

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(src)
        K.ingest_keyed_stream(stream, apps, good, bad, staging, f"{tmp_path}/ckpt", available_now=True).awaitTermination()

    spark.createDataFrame(batch(0), ROWS).coalesce(1).write.parquet(src)
    run()
    # the next batch is decided, one table gets its files, then the job stops
    spark.createDataFrame(batch(100), ROWS).coalesce(1).write.mode("append").parquet(src)
    publish = K.publish_batch

    def stops(spark, staging, number, accepted_path, rejected_path):
        publish(spark, staging, number, accepted_path, f"{tmp_path}/ckpt/offsets/0/x")  # no folder can be made there
    monkeypatch.setattr(K, "publish_batch", stops)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(K, "publish_batch", publish)
    keys[:] = [("b", "k2")]  # too late for the decided batch
    spark.createDataFrame(batch(200), ROWS).coalesce(1).write.mode("append").parquet(src)
    run()
    assert K.publish_batch(spark, staging, 1, good, bad) == 0  # once more: nothing left
    assert not K.decide_batch(spark.createDataFrame(batch(100), ROWS), apps(), staging, 1)
    rows = batch(0) + batch(100) + batch(200)
    key = lambda r: ("a", "k1") if r[0] < 200 else ("b", "k2")
    want = {r[0]: r[1:3] == key(r) for r in rows if r[4] == "ERROR"}
    accepted = [r.id for r in read_logs(spark, good).collect()]
    rejected = spark.read.parquet(bad).select("id", "reason").collect()
    assert sorted(accepted) == sorted(i for i, ok in want.items() if ok)
    assert sorted(r.id for r in rejected) == sorted(i for i, ok in want.items() if not ok)
    assert {r.reason for r in rejected} == {"wrong key", "unknown application"}
    assert "api_key" not in spark.read.parquet(bad).columns


def test_all_levels_and_an_empty_batch(spark, tmp_path):
    good, bad, staging = (f"{tmp_path}/{x}" for x in ("good", "bad", "staging"))
    apps = spark.createDataFrame([("a", "k1")], APPS)
    for n, rows in enumerate([[], batch(0)]):
        assert K.decide_batch(spark.createDataFrame(rows, ROWS), apps, staging, n, threshold=None)
        K.publish_batch(spark, staging, n, good, bad)
    both = read_logs(spark, good).select("id").union(read_logs(spark, bad).select("id"))
    assert sorted(r.id for r in both.collect()) == list(range(20))
    assert read_logs(spark, bad).filter(F.col("level") == "INFO").count()
