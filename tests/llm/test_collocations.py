import re
from collections import Counter

import duckdb
import pytest
from corpus_rows import SMALL, documents

from errorlens.llm import collocations as C


def brute(rows, least, best, covered):
    """(lang, rank, phrase, a, l, r, n, score) by the definition."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    phrases = {x: f for x, f in counts.items() if len(x[1]) > 1 and f >= least}
    out = {}
    for (lang, p), a in phrases.items():
        if any(m == lang and len(q) > len(p) and 100 * f >= covered * a
               and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (m, q), f in phrases.items()):
            continue
        score, _, l, r = min((1000 * a * sizes[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]],
                              counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for lang, x in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(x)[:best]))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of(df):
    return [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]


REPEATED = [(i, t, lang, "s") for i, (t, lang) in enumerate([
    ("A b c d e f g. a b c d e f g! a b a b a b a b, x\ty z  x y z\nx y z", "en"), ("a b a b a b c", "en"),
    ("a b a b a b c", "en"), ("\x01 a\x01 b \x01 a\x01 b a\x00 b a\x00 b a b a  b", "en"),
    ("É é É é É É É. É é", None), ("é 漢字 é 漢字 é 漢字 É é", "und"), ("only once here", "de"), (None, "fr"),
    ("ab abc ab abc ab abc ab. abc ab", ""), ("ab abc ab", ""), ("ab! abc! ab", "")])]


@pytest.mark.parametrize("least, best, covered", [(2, 2000, 100), (3, 3, 100), (2, 5, 60), (1, 2000, 100)])
def test_repeated_words_equal_brute_force(spark, least, best, covered):
    docs = documents(spark, REPEATED)
    assert got(C.collocations(docs, least, best, covered)) == brute(rows_of(docs), least, best, covered)


def test_odd_rows_and_empty_table(spark, odd, empty):
    assert got(C.collocations(odd, 2)) == brute(rows_of(odd), 2, 2000, 100)
    assert got(C.collocations(empty, 2)) == []


def test_small_corpus_equals_brute_force_in_many_slices_and_ranges(spark, small, monkeypatch):
    want = brute(rows_of(small), 12, 2000, 100)
    assert len(want) > 100
    monkeypatch.setattr(C, "SLICE_BYTES", 30_000)
    monkeypatch.setattr(C, "PATHS", 50)
    assert got(C.collocations(small, 12)) == want


def test_query_equals_sql(spark):
    from errorlens.llm.queries import oracle_sql, queries
    rows = got(queries()["op11_collocations"](spark, SMALL))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert rows and rows == sorted(con.sql(oracle_sql()["op11_collocations"]).fetchall())


def test_longest_grams_are_one_row_a_place_at_most_and_copies_add_none(spark):
    def grams(copies):
        parts = C.checkpoint(C.slices(documents(spark, REPEATED * copies).coalesce(1)))
        pairs = C.pair_counts(parts, C.word_counts(parts).select("slice", "id"))
        linked = pairs.selectExpr(f"shiftright(at, {C.COUNT_BITS}) AS slice", "pair")
        return got(C.longest_grams(parts, linked))
    once, often = grams(1), grams(30)
    places = sum(max(0, len(re.findall(r"[^\x20\x09]+", piece)) - 1)
                 for _, text, _, _ in REPEATED for piece in re.split(r"[.,;:!?\x0A-\x0D]", text or ""))
    assert once and len(once) == len({x[:2] for x in once}) and sum(x[2] for x in once) == places
    assert often == [(lang, gram, 30 * n) for lang, gram, n in once]


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    from pyspark.sql import functions as F
    wide = big.select(F.expr("(cast(1000 as decimal(38,0)) * cast(n as decimal(38,0)) * cast(n as decimal(38,0))) div "
                             "(cast(n as decimal(38,0)) * cast(200 as decimal(38,0)))")).collect()[0][0]
    assert wide == 1000 * 10**30 // (10**15 * 200)


def test_transducer():
    words = sorted(["ab", "abc", "abd", "b", "bcd", "xbcd"])
    t = C.Transducer((tuple(w), i + 1) for i, w in enumerate(words))
    for p in {w[:k] for w in words for k in range(len(w) + 1)} | {"z", "abz"}:
        assert t.prefix(p) == sum(i + 1 for i, w in enumerate(words) if w.startswith(p))
    # "bcd" after "x" is the state of "b" but for its end; "cd" and "d" are shared
    assert len(t.arcs) < 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})
    asked = C.Transducer((tuple(w), 1) for w in ["ab", "abd", "abe", "xbc", "xbcd"])
    assert dict(t.compose(asked)) == {tuple("ab"): 1, tuple("abd"): 3, tuple("xbcd"): 6}
    assert {"".join(p) for p, _ in t.prefixes(6)} == {p for p in {w[:k] for w in words for k in range(1, 5)} if t.prefix(p) >= 6}
    # equal paths of several shards add up
    assert C.Transducer([((1, 2), 3), ((1, 2), 4), ((1, 3), 5)]).prefix((1, 2)) == 7
    assert C.Transducer([]).prefix(()) == 0 and not list(C.Transducer([]).compose(asked))
