"""Exact values on the reference's own fixtures (FIXTURES.md sections 1-2)."""

from pyspark.sql import functions as F

from errorlens.functions import traces as TR
from errorlens.functions.fingerprints import java_hash_id
from errorlens.functions.templates import normalize_message
from errorlens.operators import clusters as C
from errorlens.operators import report as R
from errorlens.operators.merge import merge_similar, messages_similar
from fixtures_ref import ASOF, PARSE_TRACE, frame

NPE_FP = ("java.lang.NullPointerException|com.example.OrderService.processOrder:23|"
          "com.example.OrderController.createOrder:45")
PAY_FP = ("java.lang.IllegalStateException|com.example.PaymentService.charge:89|"
          "com.example.OrderService.processOrder:27")


def test_store_and_retrieve_errors(spark):
    df = frame(spark)
    assert df.count() == 17
    assert df.filter(F.col("level").isin("ERROR", "FATAL")).count() == 6


def test_cluster_ids_match_java_hash():
    assert java_hash_id(NPE_FP) == "ERR-716AF7A5"
    assert java_hash_id(PAY_FP) == "ERR-7DD59911"


def test_clusters_core(spark):
    cl = C.rank_clusters(C.cluster_errors(frame(spark), "core")).collect()
    assert [(r.cluster_id, r.fingerprint, r.occurrence_count, r.message_pattern, r.severity) for r in cl] == [
        ("ERR-716AF7A5", NPE_FP, 5, "Error processing order <NUM>", "LOW"),
        ("ERR-7DD59911", PAY_FP, 1, "Payment failed for customer <NUM>", "LOW"),
    ]
    npe = cl[0]
    assert npe.exception_class == "java.lang.NullPointerException"
    assert npe.first_seen < npe.last_seen == ASOF
    assert (npe.primary_file, npe.primary_line, npe.primary_method, npe.primary_class) == (
        "OrderService.java", 23, "processOrder", "com.example.OrderService")


def test_report_figures(spark):
    df = frame(spark)
    cl = C.cluster_errors(df, "core")
    s = R.summary_flags(R.health_status(R.report_summary(df, cl))).first()
    assert (s.total_logs, s.error_logs, s.cluster_count, s.critical_count, s.high_count) == (17, 6, 2, 0, 0)
    assert round(s.error_rate, 2) == 35.29
    assert s.health == "ATTENTION"
    levels = [(r.level, r["count"], round(r.percent, 1)) for r in R.level_distribution(df).collect()]
    assert levels == [("INFO", 10, 58.8), ("WARN", 1, 5.9), ("ERROR", 6, 35.3)]


def test_merge_changes_nothing(spark):
    cl = C.cluster_errors(frame(spark), "core")
    merged = merge_similar(cl).collect()
    assert sorted((r.fingerprint, r.occurrence_count) for r in merged) == sorted(
        [(NPE_FP, 5), (PAY_FP, 1)])


def test_trace_parsing(spark):
    df = spark.createDataFrame([(PARSE_TRACE,)], "t string")
    p = df.select(TR.parse_trace("t").alias("p")).first().p
    assert p.exception_class == "java.lang.RuntimeException"
    assert p.exception_message == "Failed to process"
    assert len(p.frames) == 4
    assert p.frames[0].class_name == "com.example.OrderService"
    assert p.frames[0].method_name == "processOrder" and p.frames[0].line_number == 23
    assert p.frames[2].native and p.frames[2].line_number == -1 and p.frames[2].file_name is None
    user = df.select(TR.user_frames(TR.parse_trace("t")["frames"]).alias("u")).first().u
    assert [f.class_name for f in user] == ["com.example.OrderService", "com.example.OrderController"]
    assert len(p.causes) == 1
    assert p.causes[0].exception_class == "java.lang.IllegalStateException"
    assert len(p.causes[0].frames) == 2
    root = df.select(TR.root_cause(TR.parse_trace("t")).alias("r")).first().r
    assert root.exception_class == "java.lang.IllegalStateException"


def test_normalization_examples(spark):
    rows = [("id 550e8400-e29b-41d4-a716-446655440000 gone",), ("User 12345678 not found",),
            ("Error at 2024-01-15T10:30:00",)]
    df = spark.createDataFrame(rows, "m string")
    got = [r.t for r in df.select(normalize_message("m").alias("t")).collect()]
    assert got == ["id <UUID> gone", "User <ID> not found", "Error at <TIMESTAMP>"]
    pair = spark.createDataFrame([("Failed to process order abc-123", "Failed to process order xyz-789")],
                                 "a string, b string")
    assert pair.select(messages_similar("a", "b").alias("s")).first().s is True
