"""Edge cases of the scalar rules against plain-Python rules."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from errorlens.functions import levels as LV
from errorlens.functions import mdc as MDC
from errorlens.functions import text as TX
from errorlens.functions import traces as TR
from errorlens.functions.fingerprints import cluster_id, fingerprint, java_hash_id
from errorlens.operators import clusters as C
import pyref

TRACES = [
    "",
    "\n\n\n",
    "\r\n\n",
    "NoColonHere\n\tat a.b.C.d(C.java:1)\n",
    "java.io.IOException: disk\n\tat com.x.A.run(A.java:3)\n\tat java.base/java.lang.Thread.run(Thread.java:840)\n"
    "\tat com.x.B.go(B.java:9)\n",
    "java.lang.IllegalStateException: x\n\tat com.x.A.run(A.java:3)\n\tSuppressed: java.io.IOException: y\n"
    "\t\tat com.x.C.close(C.java:4)\nCaused by: java.lang.Error: z\n",
    "a.AException: outer\n\tat com.x.A.a(A.java:1)\nCaused by: b.BException: mid\n\tat com.x.B.b(B.java:2)\n"
    "\t... 1 more\nCaused by: c.CError: root\n\tat com.x.C.c(C.java:3)\n\tat com.x.C.d(Unknown Source)\n",
    "  leading.Exception  \n   at com.x.A.a(A.java)\n",
    "\nstarts.with.Newline: m\n\tat com.x.A.a(A.java:1)\n",
    "x: y: z\r\n\tat org.apache.Foo.bar(Foo.java:1)\r\n\tat com.x.Own.m(Own.java:5)\r\n",
    "com.x.FooExceptionHandler: not an exception\n\tat com.x.A.a(A.java:1)\n",
    "   \n",
    "Caused by: only.cause.Exception: c\n\tat com.x.A.a(A.java:1)\n",
]


def test_parse_matches_python_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRACES)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", TR.parse_trace("t").alias("p")).collect()}
    for i, t in enumerate(TRACES):
        want = pyref.parse(t)
        p = got[i]
        if want is None:
            assert p is None, t
            continue
        assert (p.exception_class, p.exception_message) == want[:2], t
        assert [tuple(f) for f in p.frames] == want[2], t
        assert [(c.exception_class, c.exception_message, [tuple(f) for f in c.frames])
                for c in p.causes] == [(c[0], c[1], c[2]) for c in want[3]], t


# Core fingerprints of TRACES, by hand. Class, method and line stand in for
# a trace without any line; they are there for odd numbers, numbers that 3
# doesn't divide and numbers that 4 doesn't divide.
CORE = [
    "msg <NUM>",                                # no trace, no location: the template
    "com.x.Loc.m:7",                            # line ends only: the location
    ".m:7",
    "NoColonHere|a.b.C.d:1",
    "java.io.IOException|com.x.A.run:3",        # a module frame is no frame line and ends the parse
    "java.lang.IllegalStateException|com.x.A.run:3",  # so does "Suppressed:"
    "a.AException|com.x.A.a:1",                 # frames of causes don't count
    "leading.Exception|com.x.A.a:-1",           # a file without a line
    "",                                         # an empty head line, and no frame after it
    "x|com.x.Own.m:5",                          # framework frames are left out
    "com.x.FooExceptionHandler|com.x.A.a:1",    # no exception name: the text before the colon
    "",
    "Caused by|com.x.A.a:1",
]


def test_core_fingerprints(spark):
    rows = [(i, t, "com.x.Loc" if i % 2 else None, "m" if i % 3 else None, 7 if i % 4 else None, f"msg {i}")
            for i, t in enumerate(TRACES)]
    df = spark.createDataFrame(rows, "i int, stack_trace string, class_name string, method_name string, "
                                     "line_number int, message string")
    got = {r.i: r.fp for r in df.select("i", fingerprint("core").alias("fp")).collect()}
    assert [got[i] for i in range(len(TRACES))] == CORE


def test_exception_class_modes(spark):
    df = spark.createDataFrame([("com.x.FooExceptionHandler: boom\n",), ("\nx: y",), ("",), (None,),
                                ("  a.b.MyError  : text",)], "t string")
    core = [r.c for r in df.select(TR.exception_class("t", "core").alias("c")).collect()]
    cloud = [r.c for r in df.select(TR.exception_class("t", "cloud").alias("c")).collect()]
    assert core == ["com.x.FooExceptionHandler", "x", None, None, "a.b.MyError"]
    assert cloud == ["com.x.FooException", "", None, None, "a.b.MyError"]


@pytest.mark.parametrize("n,grade", [(9, "LOW"), (10, "MEDIUM"), (49, "MEDIUM"), (50, "HIGH"),
                                     (99, "HIGH"), (100, "CRITICAL")])
def test_severity_edges(spark, n, grade):
    assert spark.range(1).select(C.severity(F.lit(n)).alias("s")).first().s == grade


def test_level_normalization(spark):
    df = spark.createDataFrame([(None,), ("",), ("WARNING",), ("severe",), ("??",), ("fatal",), ("Debug",)],
                               "l string")
    got = [r.l for r in df.select(LV.normalize_level("l").alias("l")).collect()]
    assert got == ["INFO", "INFO", "WARN", "ERROR", "INFO", "FATAL", "DEBUG"]


def test_mdc_rules_and_round_trip(spark):
    df = spark.createDataFrame([("a=1;b=x=y;c;=z;a=2",), ("",), (None,), ("novalid",)], "m string")
    got = [r.m for r in df.select(MDC.parse_mdc("m").alias("m")).collect()]
    assert got[0] == {"a": "2", "b": "x=y"}
    assert got[1] is None and got[2] is None and got[3] == {}
    back = df.select(MDC.format_mdc(MDC.parse_mdc("m")).alias("t")).collect()
    assert back[0].t == "a=2;b=x=y" and back[3].t is None
    again = spark.createDataFrame([(back[0].t,)], "m string").select(
        MDC.format_mdc(MDC.parse_mdc("m")).alias("t")).first().t
    assert again == back[0].t


def test_cluster_id_matches_java_hash(spark):
    texts = ["", "a", "java.lang.NullPointerException|x.Y.z:1", "ünïcödé|€", "😀 emoji", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.c for r in df.select(cluster_id("t").alias("c")).collect()]
    assert got == [java_hash_id(t) for t in texts]


def test_format_count_and_preview(spark):
    df = spark.createDataFrame([(999,), (1000,), (1250,), (1150,), (999_950,), (1_250_000,)], "n long")
    got = [r.s for r in df.select(TX.format_count("n").alias("s")).collect()]
    assert got == ["999", "1.0K", "1.3K", "1.2K", "1000.0K", "1.3M"]
    p = spark.createDataFrame([("short",), ("a" * 70,), (None,)], "t string").select(
        TX.preview("t", 60, "N/A").alias("p")).collect()
    assert [r.p for r in p] == ["short", "a" * 57 + "...", "N/A"]


def test_lookback_parsing():
    d = timedelta(hours=1)
    assert TX.parse_lookback("7D", d) == timedelta(days=7)
    assert TX.parse_lookback("30m", d) == timedelta(minutes=30)
    assert TX.parse_lookback(" 7d", d) == d
    assert TX.parse_lookback("7w", d) == d
    assert TX.parse_lookback(None, d) == d


@pytest.mark.parametrize("n", [3, 4, 10])
def test_sample_positions(spark, n):
    from datetime import datetime
    # several rows share a second, so buckets hold more than one row
    rows = [(i, datetime(2024, 1, 1) + timedelta(milliseconds=300 * i), "fp") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, fingerprint string")
    got = sorted(r.sample_index for r in C.sample_entries(df, 3).collect())
    if n <= 3:
        assert got == list(range(n))
    else:
        assert got == [0, n // 2, n - 1]
