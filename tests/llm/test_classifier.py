import zlib

import numpy as np
from corpus_rows import ODD
from errorlens.llm import classifier as C
from errorlens.llm.fingerprints import encode_texts


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        starts, doc = C.chunk_starts(np.array([0, n]))
        seen = set()
        for s in starts:
            seen |= set(range(int(s), min(n, int(s) + C.CHUNK)))
        assert seen == set(range(n)) and len(starts) >= 1 and (doc == 0).all()
        assert n <= C.CHUNK or starts[1] < starts[0] + C.CHUNK


def test_scores_do_not_depend_on_the_batch():
    net = C.Network.fresh(1)
    texts = ["", "short", "abc " * 900, "é" * 700, "x"]
    whole = C.scores(net, *encode_texts(texts))
    each = [C.scores(net, *encode_texts([t]), at_once=1)[0] for t in texts]
    assert np.allclose(whole, each, atol=1e-5) and ((whole > 0) & (whole < 1)).all()


def test_it_learns_and_repeats():
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("etaoinshr"), r.integers(2, 8)))
    good = [" ".join(word() for _ in range(r.integers(5, 120))) for _ in range(120)]
    bad = [" ".join(word().upper() + "!!" for _ in range(r.integers(20, 120))) for _ in range(120)]
    texts, labels = good[:90] + bad[:90], [1] * 90 + [0] * 90
    net = C.train(texts, labels, epochs=4)
    p = C.scores(net, *encode_texts(good[90:] + bad[90:]))
    assert np.mean((p >= C.ACCEPT) == ([1] * 30 + [0] * 30)) > 0.95
    assert np.array_equal(p, C.scores(C.train(texts, labels, epochs=4), *encode_texts(good[90:] + bad[90:])))


def test_labels_outside_the_fold_only(spark, odd, empty):
    held = next(i for i in range(1, 11) if zlib.crc32(str(i).encode()) % 5 == 0)
    marks = spark.createDataFrame([(held, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = C.quality_scores(odd, marks).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}  # nothing to learn from
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == (r["score"] >= 0.3)
    assert C.quality_scores(empty, marks).collect() == []
    one = spark.createDataFrame([(1, 1), (7, 1), (6, 1), (5, 1)], "doc_id long, quality int")
    assert {r["score"] for r in C.quality_scores(odd, one).collect()} == {1.0}
    assert C.accepted(odd, odd, one).columns == odd.columns


def test_held_out_accuracy(spark):
    """On all held-out rows of a table of 1000, from its own 46 bad rows."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = C.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    bad = [r for r in rows if r["quality"] == 0]  # one in six: always saying 1 would give 0.84 above
    assert len(bad) > 5 and np.mean([r["predicted"] == 0 for r in bad]) >= 0.6


def naive_score(net, text):
    """The network by its definition: plain loops over windows and filters."""
    raw = (text or "").encode()
    begins = [0]
    while begins[-1] + C.CHUNK < len(raw):
        begins.append(begins[-1] + C.STEP)
    p, pooled = {k: v.astype(float) for k, v in net.p.items()}, []
    for b in begins:
        ids = [raw[i] if i < len(raw) else C.PAD for i in range(b, b + C.CHUNK)]
        best = [0.0] * C.FILTERS
        for at in range(0, C.CHUNK - C.WIDTH + 1, C.STRIDE):
            seen = [x for i in ids[at:at + C.WIDTH] for x in p["embed"][i]]
            for f in range(C.FILTERS):
                best[f] = max(best[f], sum(x * w for x, w in zip(seen, p["filters"][:, f])) + p["bias"][f])
        pooled.append(best)
    mean = [sum(y[f] for y in pooled) / len(pooled) for f in range(C.FILTERS)]
    top = [max(y[f] for y in pooled) for f in range(C.FILTERS)]
    feats = [*mean, *top, np.log1p(len(raw)) / 8, min(1, len(raw) / C.CHUNK)]
    hidden = [np.tanh(sum(x * w for x, w in zip(feats, p["hidden"][:, j])) + p["hidden_bias"][j]) for j in range(C.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, p["out"])) + p["out_bias"][0])))


def test_scores_by_plain_loops(spark):
    """A fitted network's scores of whole rows equal the definition's."""
    texts = [None, "", "plain words of a text", "Überall " * 70, "BUY NOW!! " * 110]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = C.train(["some good words here"] * 8 + ["BAD!! WORDS!!"] * 8, [1] * 8 + [0] * 8, epochs=2)
    for r in C.scored(rows, net).collect():
        assert abs(r["score"] - naive_score(net, r["text"])) < 1e-4
