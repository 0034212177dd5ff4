import random
import zlib

from corpus_rows import ODD  # noqa: F401
from errorlens.llm import sharding as S


def brute_capacity(sizes, n):
    """Smallest largest shard over all contiguous partitions."""
    best = {0: 0}
    for _ in range(n):
        best = {j: min(max(best[i], sum(sizes[i:j])) for i in best if i <= j) for j in range(len(sizes) + 1)}
    return best[len(sizes)]


def test_capacity_is_minimal_and_cuts_keep_it():
    r = random.Random(5)
    for _ in range(150):
        sizes = [r.choice([0, 1, 2, 5, 40]) + r.randrange(9) for _ in range(r.randrange(1, 14))]
        n = r.randrange(1, 7)
        capacity, cuts = S.minimax_cuts(sizes, n)
        assert capacity == brute_capacity(sizes, n)
        edges = [0, *cuts, len(sizes)]
        assert edges == sorted(edges) and max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) <= capacity
    assert S.minimax_cuts([], 3) == (0, [0, 0])


def test_shards_of_documents(small):
    rows = S.shard_map(small, 40).collect()
    text = {r["doc_id"]: r["text"] for r in small.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    shards = {}
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) <= set(range(40))
    last = -1
    for s in sorted(shards):
        ids = [r["doc_id"] for r in sorted(shards[s], key=lambda r: r["slot"])]
        assert [r["slot"] for r in sorted(shards[s], key=lambda r: r["slot"])] == list(range(len(ids)))
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    ordered = [r["size"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert max(sum(r["size"] for r in x) for x in shards.values()) == S.minimax_cuts(ordered, 40)[0]


def test_odd_rows_and_empty_table(odd, empty):
    rows = S.shard_map(odd, 3).collect()
    assert len(rows) == len(ODD)
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {16}
    assert {r["text_crc32"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert sorted(r["slot"] for r in rows if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in rows)))
    assert S.shard_map(empty, 3).collect() == []


def test_a_hot_key_is_split(spark):
    from pyspark.sql import functions as F
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 10).alias("text"))
    rows = S.shard_map(same, 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in rows) == [1000] * 4


def test_written_shards(spark, small, tmp_path):
    placed = S.text_shard_map(small, 5)
    S.write_shards(small, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == small.count()
    want = {r["doc_id"]: (r["shard"], r["slot"]) for r in placed.collect()}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in back.collect()} == want


def test_equal_texts_share_a_shard(spark):
    from corpus_rows import documents
    r = random.Random(3)
    rows = [(i, f"text {r.randrange(120)} " * r.choice([1, 2, 30]), "en", "s") for i in range(600)] + [
        (None, "text 5 ", "en", "s"), (9, None, "en", "s"), (700, "", "en", "s")]
    groups = {}
    for i, t, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        groups.setdefault(t or "", []).append(i)
    sizes = [(len(t) + 16) * len(x) for t, x in groups.items()]
    for n in (1, 7, 40):
        got = S.text_shard_map(documents(spark, rows), n).collect()
        assert len(got) == len(rows)
        text, shards = {(i, zlib.crc32((t or "").encode())): t or "" for i, t, *_ in rows}, {}
        for x in got:
            shards.setdefault(text[x["doc_id"], x["text_crc32"]], set()).add(x["shard"])
        assert all(len(x) == 1 for x in shards.values())
        places = sorted((x["shard"], x["slot"]) for x in got)
        assert all(k == 0 if a != b else k == j + 1 for (a, j), (b, k) in zip([(-1, 0), *places], places))
        full = [sum(x["size"] for x in got if x["shard"] == k) for k in range(n)]
        assert max(full) == S.minimax_cuts(sizes, n)[0]


def test_the_capacity_is_minimal_however_coarse_the_steps(spark):
    from pyspark.sql import functions as F
    r = random.Random(11)
    for n, top in ((3, 30), (8, 3000), (5, 90)):
        sizes = [r.choice([r.randrange(top), 7 * top if r.random() < 0.01 else 1]) for _ in range(900)]
        docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, size long")
        out = S.minimax_shards(docs, n, [F.col("doc_id")], "size", resolution=2)
        assert max(x[0] for x in out.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()) == S.minimax_cuts(sizes, n)[0]


def test_every_row_is_written_once(spark, odd, empty, tmp_path):
    """Also rows without an id whose texts have one CRC-32, and repeated ones."""
    from corpus_rows import documents
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    rows = [(None, "plumless", "en", "a"), (None, "buckeroo", "en", "b"), (1, "plumless", "en", "c"), (1, "plumless", "de", "d")]
    for k, docs in enumerate((documents(spark, rows), odd)):
        S.write_shards(docs, f"{tmp_path}/{k}", 3)
        back = spark.read.parquet(f"{tmp_path}/{k}")
        kept = [c for c in docs.columns if c not in ("shard", "slot")]
        quoted = [f"`{c}`" for c in kept]
        assert sorted(map(repr, back.select(*quoted).collect())) == sorted(map(repr, docs.select(*quoted).collect()))
        assert back.select("shard", "slot").distinct().count() == back.count()
    S.write_shards(empty, f"{tmp_path}/none", 3)


def test_a_task_holds_one_python_worker(spark):
    """Running sums and what is made of them are one step over Arrow batches;
    two would keep two workers and their batches a task."""
    docs = spark.createDataFrame([(i % 7, "a" * (i % 5)) for i in range(60)], "doc_id long, text string")
    for out in (S.shard_map(docs, 4), S.text_shard_map(docs, 4)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert out.count() == 60
