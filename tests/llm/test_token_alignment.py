import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_rows import SMALL

from errorlens.llm import token_alignment as T


@pytest.fixture(scope="module")
def v():
    return T.Vocabularies(open(T.BYTE_BPE, "rb").read(), open(T.PIECE_BPE, "rb").read())


class Plain:
    """The two tokenizers by their own libraries, and the definition of groups."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(T.BYTE_BPE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=T.PIECE_BPE)
        # bytes of the byte-level characters, by the decoder of the library
        from tokenizers.pre_tokenizers import ByteLevel
        self.byte = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0]: bytes([i])
                     for i in range(128)}
        for i in range(128, 2048):
            c, raw = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0], chr(i).encode()
            self.byte |= {x: bytes([y]) for x, y in zip(c, raw)}
        for lead in "ࠀက 　䀀倀怀瀀耀退ꀀ뀀쀀퀀\U00010000\U00040000\U00080000\U000c0000\U00100000":
            c = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(lead)[0][0]
            self.byte |= {x: bytes([y]) for x, y in zip(c, lead.encode())}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        """[(A ids, B ids)] of a text."""
        if not text:
            return []
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, b"".join(self.byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = [(i, self.piece(i)) for i in self.b.encode(text)]
        whole = (" " + text).encode()
        if any(b"".join(t for _, t in side) != whole for side in (a, b)):
            return []
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (a, b)]
        out, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            group = []
            for side, tokens in enumerate((a, b)):
                first, at[side] = at[side], ends[side].index(end, at[side]) + 1
                group.append([i for i, _ in tokens[first:at[side]]])
            out.append(tuple(group))
        return out


def brute(rows):
    plain, docs = Plain(), []
    for _, text in rows:
        groups = plain.groups(text)
        docs.append((groups, Counter((x, y) for a, b in groups for x in a for y in b)))
    held = Counter(p for _, links in docs for p in links)
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, _), (groups, links) in zip(rows, docs):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


STRANGE = ["a", " ", "  ", "a ", "a  ", "\n", " \n ", "a\n  b\t\tc \n d", "x  y", "x  y　 z", "▁ a", "a ▁b", "<|endoftext|> <s> </s>",
           "<unk> x", "été 漢字 \U0001f642\U0001f642 x", "a\x00b \x1c c", "'s it's  we'll", "café café  café", "﻿a b", "1 22 333   4444",
           "\U0001f642 \U0001f468‍\U0001f469 ok", "ab" * 500, "ༀ༁ ༂", "\x85 a\x85 b", "  x ᠎ y", "end  x", "a\r\n b  \r\n"]


def test_odd_rows_equal_brute_force(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(T.aligned_documents(odd)) == brute(rows)


def test_strange_texts_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(STRANGE)]
    assert got(T.aligned_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table(spark, empty):
    assert T.aligned_documents(empty).count() == 0


def test_query_equals_brute_force(spark, small, monkeypatch):
    from errorlens.llm.queries import queries
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(queries()["op13_token_alignment"](spark, SMALL)) == want
    # many parts and slices give the same
    monkeypatch.setattr(T, "PART_BYTES", 20_000)
    monkeypatch.setattr(T, "SLICE_BYTES", 60_000)
    monkeypatch.setattr(T, "CALL_BYTES", 500)
    many = T.align(small)
    assert many.count() > 3
    assert got(T.aligned_documents(small)) == want


def test_postings_of_a_pair(spark, small):
    plain = Plain()
    held = defaultdict(Counter)
    for r in small.select("doc_id", "text").collect():
        for a, b in plain.groups(r["text"]):
            for x in a:
                for y in b:
                    held[x, y][r["doc_id"]] += 1
    asked = sorted(held, key=lambda p: (-len(held[p]), p))[:3] + sorted(held)[:3]
    rows = T.pair_documents(T.align(small), asked).collect()
    assert sorted(map(tuple, rows)) == sorted((a, b, d, n) for a, b in asked for d, n in held[a, b].items())


def test_wide_groups(v, monkeypatch):
    plain = Plain()
    chunks = [(" " + t).encode() for t in ("éé漢字ab" * 30, "word", "zzzzzzzyyyy" * 9)]
    pairs = lambda c: {p: int(c.times[c.pair == p].sum()) for p in set(c.pair.tolist())}
    narrow = T.cut(chunks, np.ones(3, bool), v)
    monkeypatch.setattr(T, "WIDE_GROUP", 1)
    assert pairs(T.cut(chunks, np.ones(3, bool), v)) == pairs(narrow)
    assert narrow.groups[1] == b";".join(b",".join(b"%d" % x for x in a) + b"|" + b",".join(b"%d" % x for x in b)
                                         for a, b in plain.groups("word"))


def test_packed_index_comes_back_and_merges():
    rng = np.random.default_rng(1)
    for n in (1, 7, 300):
        pair, doc = rng.integers(0, 40, 900) ** 2, rng.integers(0, n, 900)
        times = rng.integers(1, 9, 900)
        index = T.PairIndex.of(n, pair, doc, times)
        back = T.PairIndex.unpacked(n, index.packed())
        for x in ("pairs", "counts", "docs", "times"):
            assert np.array_equal(getattr(back, x), getattr(index, x))
        want = Counter()
        for p, d, t in zip(pair.tolist(), doc.tolist(), times.tolist()):
            want[p, d] += t
        assert dict(zip(zip(np.repeat(index.pairs, index.counts).tolist(), index.docs.tolist()), index.times.tolist())) == want
        halves = [T.PairIndex.of(n, pair[s], doc[s], times[s]) for s in (slice(0, 450), slice(450, 900))]
        both = T.PairIndex.merged(halves)
        assert np.array_equal(both.docs, index.docs) and np.array_equal(both.times, index.times)
        assert both.links().tolist() == [sum(t for (q, _), t in want.items() if q == p) for p in both.pairs.tolist()]
