"""Property checks: random traces against the plain-Python rules, template
idempotence, count conservation, and the merge rounds against the greedy
loop of the reference."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from errorlens.functions import traces as TR
from errorlens.functions.templates import normalize_message
from errorlens.operators import clusters as C
from errorlens.operators.merge import merge_leaders
import pyref

LINES = ["\tat com.x.A.a(A.java:1)", "\tat java.util.List.get(List.java:2)", "\tat com.x.B.b(Native Method)",
         "\tat com.x.C.c(Unknown Source)", "\tat com.x.D.d(D.kt:4)", "\t... 3 more", "Caused by: x.YException: why",
         "Caused by: plain text", "\tSuppressed: z.Z", "", "  at io.netty.E.e(E.java:5)",
         "\tat java.base/java.lang.Thread.run(Thread.java:840)", "random words here"]
HEADS = ["java.lang.NullPointerException", "a.b.CError: msg: more", "no colon at all", ":leading colon",
         "  spaced.Exception  ", "x.y.Throwable:", ""]

trace_st = st.builds(lambda h, body, nl, crlf: (("\r\n" if crlf else "\n").join([h] + body) + ("\n" * nl)),
                     st.sampled_from(HEADS), st.lists(st.sampled_from(LINES), max_size=8),
                     st.integers(0, 2), st.booleans())


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(trace_st, min_size=60, max_size=60))
def test_random_traces_parse_like_python(spark, traces):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(traces)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", TR.parse_trace("t").alias("p")).collect()}
    for i, t in enumerate(traces):
        want = pyref.parse(t)
        p = got[i]
        if want is None:
            assert p is None
            continue
        assert (p.exception_class, p.exception_message, [tuple(f) for f in p.frames]) == want[:3], repr(t)
        assert [(c.exception_class, c.exception_message, [tuple(f) for f in c.frames]) for c in p.causes] == \
            [tuple(c) for c in want[3]], repr(t)


def test_templates_idempotent_and_counts_conserved(spark):
    from __spark_entry__ import logs
    lg = logs(spark, "/root/testdata/sf0.001")
    once = lg.select(normalize_message("message").alias("t"))
    twice = once.select(F.col("t"), normalize_message("t").alias("t2"))
    assert twice.filter(F.col("t") != F.col("t2")).count() == 0
    cl = C.cluster_errors(lg, "core")
    errors = lg.filter(F.col("level").isin("ERROR", "FATAL")).count()
    assert cl.agg(F.sum("occurrence_count")).first()[0] == errors
    assert errors == 201 and cl.count() == 14


def test_merge_rounds_keep_the_definition(spark):
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta"]
    for trial in range(3):
        rows = []
        for k in range(40):
            cls = rnd.choice(["E1", "E2", None])
            pat = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
            loc = rnd.choice([None, ("c.A", "m", 1), ("c.A", "m", 2), ("c.B", None, None)])
            rows.append({"fingerprint": f"fp{trial}-{k}", "occurrence_count": rnd.randint(1, 20),
                         "last_seen_s": rnd.randint(0, 5), "exception_class": cls, "message_pattern": pat,
                         "primary_class": loc[0] if loc else None, "primary_method": loc[1] if loc else None,
                         "primary_line": loc[2] if loc else None})
        ranked = sorted(rows, key=lambda r: (-r["occurrence_count"], -r["last_seen_s"], r["fingerprint"]))

        def related(a, b):
            if a["exception_class"] == b["exception_class"] and pyref.similarity(
                    a["message_pattern"], b["message_pattern"]) >= 0.7:
                return True
            return (a["primary_class"] is not None and a["primary_class"] == b["primary_class"]
                    and a["primary_method"] == b["primary_method"] and a["primary_line"] == b["primary_line"])

        df = spark.createDataFrame(
            [(r["fingerprint"], r["occurrence_count"], r["last_seen_s"], r["exception_class"], r["message_pattern"],
              r["primary_class"], r["primary_method"], r["primary_line"]) for r in rows],
            "fingerprint string, occurrence_count long, last_seen_s long, exception_class string, "
            "message_pattern string, primary_class string, primary_method string, primary_line int")
        df = df.withColumn("last_seen", F.timestamp_seconds("last_seen_s"))
        got = {r.fingerprint: r.leader for r in merge_leaders(df).collect()}
        # by the definition: no leader is related to an earlier leader, and
        # a follower's leader is the earliest leader related to it
        leaders = [r for r in ranked if got[r["fingerprint"]] == r["fingerprint"]]
        for r in ranked:
            earlier = [x for x in leaders if ranked.index(x) < ranked.index(r) and related(x, r)]
            assert got[r["fingerprint"]] == (earlier[0] if earlier else r)["fingerprint"], trial


def test_template_pairs_salted_blocks_equal_brute_force(spark):
    from errorlens.operators.merge import similar_template_pairs
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "x"]
    keys = {(rnd.choice(["E1", None]), " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))))
            for _ in range(60)}
    keys = sorted(keys, key=repr)
    df = spark.createDataFrame(keys, "exception_class string, template string")
    want = {(c1, t1, t2) for c1, t1 in keys for c2, t2 in keys
            if c1 == c2 and t1 != t2 and pyref.similarity(t1, t2) >= 0.7}
    for block in (2, 1000):
        got = {(r.exception_class, r.template_a, r.template_b)
               for r in similar_template_pairs(df, block_rows=block).collect()}
        assert got == want, block
