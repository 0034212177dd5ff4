"""Joins beyond their broadcast bound: same rows, and nothing wide is shuffled."""

import pytest

from errorlens.operators import clusters as C
from errorlens.operators import insight as I
from errorlens.operators import sizes


@pytest.fixture
def small_log(spark):
    import __spark_entry__ as E
    lg = E.logs(spark, "/root/testdata/sf0.001")
    return lg, C.cluster_errors(lg, mode="cloud")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_pattern_samples_without_broadcasts(spark, small_log, monkeypatch):
    lg, cl = small_log
    want = rows(I.sample_logs_by_pattern(cl, lg, 3, tokens_as_wildcards=True))
    assert len(want) > 20
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", -1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(I.sample_logs_by_pattern(cl, lg, 3, tokens_as_wildcards=True)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_newest_entries_by_shuffle(spark, small_log, monkeypatch):
    lg, _ = small_log
    cl = C.cluster_errors(lg, "core", with_newest_id=True)
    want = rows(C.newest_entries(lg, cl).select("id", "fingerprint", "message"))
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", -1)
    assert rows(C.newest_entries(lg, cl).select("id", "fingerprint", "message")) == want


def test_row_bytes(spark):
    df = spark.createDataFrame([("abc", 1, ["x"]), (None, None, None), ("é", 2, [])], "s string, n long, a array<string>")
    got = [r[0] for r in df.select(sizes.row_bytes(df)).collect()]
    assert got[0] == 48 + 3 + len('{"a":["x"]}') and got[1] == 48 + len("{}") and got[2] == 48 + 2 + len('{"a":[]}')
    assert sizes.is_small(df, 10_000) and not sizes.is_small(df, 100) and sizes.is_small(df.limit(0))
