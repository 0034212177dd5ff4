"""The gram index chooses files without losing a match."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from errorlens.operators import gram_index as G
from errorlens.operators.insight import sample_logs_by_pattern
from errorlens.sources.logs import delete_older_than_on_disk, read_logs, write_logs

ROWS = "id long, app_id string, timestamp timestamp, level string, message string, stack_trace string"
WORDS = ["Order", "lost", "disk", "FULL", "50%", "a_b", "timeout", "ß", "İx", "user", "q"]
CLUSTERS = "app_id string, cluster_id string, fingerprint string, message_pattern string"


def rows(rng, n, first, days):
    return [(first + i, rng.choice(["a", "b", None]), datetime(2024, 1, rng.choice(days), rng.randint(0, 23)),
             rng.choice(["ERROR", "FATAL", "INFO"]),
             rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))]), "t") for i in range(n)]


def same(spark, clusters, path, base):
    got = G.sample_logs_stored(spark, clusters, path, base)
    want = sample_logs_by_pattern(clusters, read_logs(spark, path))
    key = lambda r: tuple(str(x) for x in r)
    got = got.select(*want.columns).collect()
    assert sorted(map(key, got)) == sorted(map(key, want.collect())) and got


def test_no_match_is_lost_while_files_come_and_go(spark, tmp_path):
    rng = random.Random(5)
    path, base = f"{tmp_path}/logs", f"{tmp_path}/index"
    asked = ["order lost", "DISK", "50%", "a_b", "i̇x", "ß", "%", None, "", "absent words", "t%o", "user timeout"]
    clusters = spark.createDataFrame([(a, f"c{i}", f"{a}{i}", p) for a in ("a", "b") for i, p in enumerate(asked)], CLUSTERS)
    assert G.refresh_gram_index(spark, path, base) == 0  # no table yet
    write_logs(spark.createDataFrame(rows(rng, 120, 0, [1, 2, 3, 4]), ROWS), path)
    assert G.refresh_gram_index(spark, path, base) == 4
    assert G.refresh_gram_index(spark, path, base) == 0
    write_logs(spark.createDataFrame(rows(rng, 60, 1000, [3, 5]), ROWS), path)
    same(spark, clusters, path, base)  # two files the index doesn't know
    assert G.refresh_gram_index(spark, path, base) == 2
    delete_older_than_on_disk(spark, path, "2024-01-02 12:00:00")
    assert G.refresh_gram_index(spark, path, base) == 1
    same(spark, clusters, path, base)


def test_files_read_follow_the_rarity_of_the_pattern(spark, tmp_path):
    path, base = f"{tmp_path}/logs", f"{tmp_path}/index"
    days = range(1, 21)
    data = [(d * 10 + i, "a", datetime(2024, 1, d, i), "ERROR",
             "connection refused" + (" by zebra" if d == 7 and i == 3 else " on mondays" if d % 7 == 0 else ""), None)
            for d in days for i in range(5)]
    write_logs(spark.createDataFrame(data, ROWS), path)
    assert G.refresh_gram_index(spark, path, base) == 20

    def files(app, text):
        c = spark.createDataFrame([(app, "f", text)], "app_id string, fingerprint string, message_pattern string")
        asked = c.select("app_id", "fingerprint", G.pattern_grams(F.col("message_pattern")).alias("grams"))
        return sorted(r["file"][9:19] for r in G.matching_files(spark, base, asked).collect())
    assert files("a", "ZEBRA") == ["2024-01-07"]
    assert files("a", "refused%mondays") == ["2024-01-07", "2024-01-14"]
    assert len(files("a", "refused")) == 20
    assert files("b", "refused") == []  # another application's rows
    assert files("a", "zebras") == []
