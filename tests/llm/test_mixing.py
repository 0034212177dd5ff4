from collections import defaultdict

from corpus_rows import ODD, documents
from errorlens.llm import mixing as M


def test_shares_by_hand():
    # 150 % of 100; by weight 93.75, 37.5, 18.75; the first stops at 20, its
    # excess goes 2 to 1: 86.67 and 43.33; the second stops at 80
    assert M.share_out([10, 40, 50], [5, 2, 1], 150, 2) == [20, 80, 50]
    assert M.share_out([100, 100], [5, 1], 120, 2) == [100, 20]
    assert M.share_out([], [], 0, 2) == [] and M.share_out([0, 5], [5, 2], 7.5, 2) == [0, 7.5]


def test_budgets_and_reruns(small):
    rows = M.mix(small).collect()
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in M.mix(small).collect())
    text = {r["doc_id"]: r["text"] for r in small.collect()}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]].encode().split()) and 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    names = sorted(by)
    targets = M.share_out([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))],
                          1.5 * sum(sizes.values()), 2)
    for s, t in zip(names, targets):
        x = sorted(by[s], key=lambda r: (r["draw_key"], r["doc_id"]))
        assert {(r["source_size"], round(r["target"], 6)) for r in x} == {(sizes[s], round(t, 6))}
        assert sum(r["taken"] for r in x) == int(t + 0.5)
        # whole epochs first; then the smallest keys up to the budget
        left = int(t + 0.5) - int(t // sizes[s]) * sizes[s]
        for r in x:
            part = min(max(left, 0), r["size"])
            assert r["taken"] == r["epochs"] * r["size"] + part and r["copies"] == r["epochs"] + (left > 0)
            left -= r["size"]


def test_draws_follow_the_weights(spark):
    """Clean texts come before symbol soup more often than not."""
    rows = [(i, ("word text more words " if i % 2 else "$$$ %%% &&& ### ") * 3, "en", "s") for i in range(600)]
    keys = sorted(M.mix(documents(spark, rows)).collect(), key=lambda r: r["draw_key"])
    assert sum(r["doc_id"] % 2 for r in keys[:200]) > 170


def test_odd_rows_and_empty_table(odd, empty):
    rows = M.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert M.mix(empty).collect() == []


def test_written_rows(spark, odd, empty):
    plan = M.mix(odd)
    out = M.mixed_rows(odd, plan).collect()
    want = defaultdict(int)
    for r in plan.collect():
        want[r["doc_id"]] += r["copies"]
    got = defaultdict(int)
    for r in out:
        got[r["doc_id"]] += 1
    assert got == {k: n for k, n in want.items() if n}
    assert out[0]["size"] == "clash size" and M.mixed_rows(empty, M.mix(empty)).collect() == []


def test_more_sources_than_the_driver_should_see(spark):
    from pyspark.sql import functions as F
    n = 150_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("s%07d", "id").alias("source"),
                                 F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    got = M.mix(docs)
    want = M.share_out([i % 7 for i in range(n)], [(5, 2, 1)[i % 3] for i in range(n)], 1.5 * sum(i % 7 for i in range(n)), 2)
    rows = sorted(got.select("doc_id", "target", "taken").collect())
    assert len(rows) == n
    assert all(abs(r["target"] - t) < 1e-6 and abs(r["taken"] - t) <= 0.5 + 1e-6 for r, t in zip(rows, want))
