import hashlib

import numpy as np
import pytest
from corpus_rows import ODD, documents
from errorlens.llm import fingerprints as P


def brute_digest(text):
    raw, counts = text.encode(), [0] * P.BUCKETS
    for i in range(len(raw)):
        for salt, (j, k) in enumerate(P.TRIPLETS):
            if i + k < len(raw):
                h = (raw[i] * 0x9E3779B1 + raw[i + j] * 0x85EBCA77 + raw[i + k] * 0xC2B2AE3D
                     + (salt * 0x27D4EB2F & 0xFFFFFFFF)) & 0xFFFFFFFF
                h ^= h >> 15
                counts[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 24] += 1
    order = sorted(counts)
    codes = [sum(c > order[P.BUCKETS * q // 4 - 1] for q in (1, 2, 3)) for c in counts]
    return bytes(sum(codes[4 * i + j] << 2 * j for j in range(4)) for i in range(P.BUCKETS // 4))


def test_digests_by_hand(monkeypatch):
    texts = ["", "a", "ab", "abc", "abcdefgh" * 40, "äöü" * 100, "the quick brown fox " * 30, ""]
    got = P.digests(*P.encode_texts(texts))
    monkeypatch.setattr(P, "STEP", 37)  # the steps' overlap changes nothing
    assert (P.digests(*P.encode_texts(texts)) == got).all()
    for t, d in zip(texts, got):
        assert bytes(d[1:]) == brute_digest(t)
    assert got[0, 0] == 0 and got[4, 0] > got[3, 0]


def check(rows, got):
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = []
    for (i, t), (_, x) in zip(rows, [*rows[1:], *rows[:1]]):
        k = len(t) // 3
        e = t[:len(t) - k] + x[:k] if k else t
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, x))
    d = {t: P.digests(*P.encode_texts([t])) for w in want for t in w[3:]}
    full = sorted(((i, n, s, bytes(d[t][0]).hex(), bytes(d[e][0]).hex(), round(float(P.likeness(d[t], d[e])[0]), 9),
                    round(float(P.likeness(d[t], d[x])[0]), 9)) for i, n, s, t, e, x in want), key=repr)
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=repr) == full


def test_small_documents(small):
    check([(r["doc_id"], r["text"]) for r in small.collect()], P.edited_likeness(small, 7).collect())


def test_odd_rows(spark):
    unique = [r for k, r in enumerate(ODD) if r[0] is not None and k != 7]
    check(unique, P.edited_likeness(documents(spark, unique)).collect())


@pytest.mark.parametrize("n", [1, 2])
def test_few_rows(spark, n):
    rows = ODD[:n]
    check(rows, P.edited_likeness(documents(spark, rows)).collect())


def test_repeated_rows_and_empty_table(odd, empty):
    assert len(P.edited_likeness(odd).collect()) == len(ODD)
    assert P.edited_likeness(empty).collect() == []


def test_likeness_is_bounded_and_tells_edits_apart(small):
    rows = P.edited_likeness(small).collect()
    near, other = np.array([r["near_edited"] for r in rows]), np.array([r["near_next"] for r in rows])
    assert ((0 <= near) & (near <= 1) & (0 <= other) & (other <= 1)).all()
    assert np.mean(near > other) > 0.9
    same = P.digests(*P.encode_texts(["some text", "some text"]))
    assert P.likeness(same[:1], same[1:])[0] == 1
