import random

import numpy as np
import xxhash
from corpus_rows import ODD, documents
from errorlens.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Root (smallest) of each fingerprint by search over all pairs."""
    fps, root = sorted(set(fps)), {}
    for f in fps:
        if f not in root:
            todo = [f]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = f
                    todo += [y for y in fps if bin(x ^ y).count("1") <= 4]
    return root


def check(rows, got):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_components(fps)
    least = {}
    for (i, *_), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for (i, *_), f in zip(rows, fps)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == want


def test_odd_rows_and_empty_table(odd, empty):
    check(ODD, S.near_duplicates(odd).collect())
    assert S.near_duplicates(empty).collect() == []


def test_small_documents(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    check(rows, S.near_duplicates(small).collect())


def test_index_finds_all_pairs():
    r = random.Random(3)
    fps = set()
    for _ in range(200):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 9)):
            y = x
            for b in r.sample(range(64), r.randrange(0, 7)):
                y ^= 1 << b
            fps.add(y)
    fps = np.array(sorted(fps), dtype=np.uint64)
    group = np.array([int(f) % 3 for f in fps])
    order = np.lexsort((S.gray_rank(fps), group))
    group, fps = group[order], fps[order]
    a, b = S.linked_pairs(group, fps, 4)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
            if group[i] == group[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 4}
    assert {(int(i), int(j)) for i, j in zip(a, b)} == want


def test_pairs_of_a_dense_group_come_in_small_chunks():
    """All of 2016 fingerprints are near each other: two million pairs."""
    fps = np.array([1 << i | 1 << j for i in range(64) for j in range(i)], dtype=np.uint64)
    fps = fps[np.argsort(S.gray_rank(fps))]
    sizes = [len(a) for a, _ in S.linked_chunks(np.zeros(len(fps), np.int64), fps, 4)]
    assert sum(sizes) == len(fps) * (len(fps) - 1) // 2
    assert max(sizes) <= S.FAN ** 2 * 512


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (S.gray_rank(n ^ n >> np.uint64(1)) == n).all()


def test_large_groups_are_split_further(spark, monkeypatch):
    """One dense cluster and a chain, with groups far over the bound."""
    monkeypatch.setattr(S, "GROUP_ROWS", 8)
    r, fps = random.Random(9), {0}
    while len(fps) < 120:  # all share their upper half
        fps.add(r.getrandbits(14) << 3)
    x = 1 << 63
    for b in range(0, 60, 3):
        x ^= 7 << b
        fps.add(x)
    links = S.links(spark.createDataFrame([(S.signed(f),) for f in fps], "fp long"))
    got = {x["node"]: x["root"] for x in S.components(links).collect()}
    root = brute_components([S.signed(f) % (1 << 64) for f in fps])
    groups = lambda m: {frozenset(k for k in fps if m(k) == m(f)) for f in fps}
    assert groups(lambda f: got.get(S.signed(f), S.signed(f))) == groups(lambda f: root[f])


def test_groups_stay_whole_when_their_join_becomes_a_broadcast(spark):
    """The join of the groups is planned as a merge and made a broadcast at run time, which reads its rows by map task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    r, fps = random.Random(6), set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(12):  # copies of one text, each a bit or two away from it
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 3))))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long").repartition(7)
        got = {x["node"]: x["root"] for x in S.components(S.links(S.checkpoint(rows))).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    root = brute_components(fps)
    groups = lambda m: {frozenset(k for k in fps if m(k) == m(f)) for f in fps}
    assert groups(lambda f: got.get(S.signed(f), S.signed(f))) == groups(lambda f: root[f])


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in S.components(edges).collect()}
    assert {got.get(i, i) for i in range(n)} == {0} and got[501] == 500


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e f", "en", "s"), (3, "a b c d e f", "en", "s"), (3, "a b c d e f", "en", "s"),
            (8, "other words stand in this text", "en", "s"), (None, "lonely text without any id", "en", "s")]
    kept = S.deduplicated(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == [3, 8, None]
    assert "clash h" in kept[0].asDict().values()
