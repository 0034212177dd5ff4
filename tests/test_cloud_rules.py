"""cloud-mode rules (ECMAScript semantics): each row with its fingerprint
and exception class, worked out by hand from the rules of SURVEY 2.8."""

from errorlens.functions.fingerprints import fingerprint
from errorlens.functions.traces import exception_class

# stack_trace, class_name, method_name, line_number, message -> fingerprint, exception class
ROWS = [
    # a framework frame is skipped; the class ends with the last "Exception" of the word
    (("a.FooExceptionHandler: x\n\tat com.x.A.a(A.java:1)\n\tat java.util.B.b(B.java:2)\n", "C", "m", 5, "msg 1"),
     "com.x.A.a:A.java:1", "a.FooException"),
    # no frame: the location; line 0 counts as missing
    (("no frames here", "com.x.Loc", None, 0, "msg 2"), "com.x.Loc", "no frames here"),
    # nothing at all
    (("", "", "", 0, ""), "unknown", None),
    ((None, None, "onlyMethod", 7, None), "onlyMethod|7", None),
    # frames under a cause count like any other
    (("x\n  at com.x.Nb.go(Nb.java:3)\nCaused by: y\n\tat com.x.Deep.d(Deep.java:4)\n", None, None, None, "m"),
     "com.x.Nb.go:Nb.java:3|com.x.Deep.d:Deep.java:4", "x"),
    # one frame a line, the first: here a framework's
    (("\tat org.apache.X.y(X.java:1) then at com.x.Z.w(Z.java:9)\n", None, None, None, "m"),
     "m", "at org.apache.X.y(X.java"),
    # five frames at most
    (("e\n" + "".join(f"\tat com.x.C{i}.m(C{i}.java:{i})\n" for i in range(8)), None, None, None, "m"),
     "com.x.C0.m:C0.java:0|com.x.C1.m:C1.java:1|com.x.C2.m:C2.java:2|com.x.C3.m:C3.java:3|com.x.C4.m:C4.java:4", "e"),
    # a blank message is a message; its template is empty
    ((None, None, None, None, "   "), "", None),
    # no-break and em spaces are white space here
    (("E\n\tat\u00a0com.x.Nbsp.go(Nbsp.java:2)\n\tat\u2003org.apache.Q.q(Q.java:1)\n", None, None, None, "m"),
     "com.x.Nbsp.go:Nbsp.java:2", "E"),
    ((None, None, None, None, "\u00a0 spaced 12 \u3000"), "spaced 12", None),
]


def test_cloud_fingerprints(spark):
    df = spark.createDataFrame([(i, *r) for i, (r, _, _) in enumerate(ROWS)],
                               "i int, stack_trace string, class_name string, method_name string, "
                               "line_number int, message string")
    got = {r.i: (r.fp, r.cls) for r in df.select(
        "i", fingerprint("cloud").alias("fp"), exception_class("stack_trace", "cloud").alias("cls")).collect()}
    assert got == {i: (fp, cls) for i, (_, fp, cls) in enumerate(ROWS)}
