import corpus_pipeline as P
from corpus_rows import SMALL


def test_stages_in_order(spark):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "source mix", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SMALL).cache()
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= before and ids
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
            docs, before = out, ids
    assert {r["shard"] for r in out.collect()} <= set(range(40))


def test_run_is_the_stages_one_after_another(spark):
    rows = P.run(spark, SMALL).collect()
    assert len(rows) > 100 and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_stages_keep_other_columns_and_take_odd_rows(spark, odd, empty):
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, odd, SMALL)
        assert out.columns == odd.columns and out.count() > 0, k
        clash = [c for c in odd.columns if odd.schema[c].nullable is False]
        assert len(clash) > 30
        assert all(tuple(r) == tuple(f"clash {c}" for c in clash) for r in out.select(*[f"`{c}`" for c in clash]).collect()), k
        assert stage(spark, empty, SMALL).collect() == []
    assert P.STAGES[-1][1](spark, empty, SMALL).collect() == []
