import hashlib
import re
from collections import defaultdict

from corpus_rows import ODD, SMALL, documents
from errorlens.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[i:i + 13])].add(str(item))
    lengths = {len(w) for w in wins}
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in wins:
                    hit |= set(range(a, a + n))
                    found |= wins[tuple(w[a:a + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
                   for r in df.collect()), key=repr)


def test_small_documents(spark, small):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = D.contamination(small, items)
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert result(got) == brute(docs, [(r[0], r[1]) for r in items.select("item_id", "text").collect()])
    assert any(r["contaminated"] for r in got.collect())
    bad = {r["doc_id"] for r in got.collect() if r["contaminated"]}
    assert {r["doc_id"] for r in D.clean_documents(small, items).collect()} == {i for i, _ in docs} - bad


ITEMS = [(1, "one two three"), (2, "Four, five; SIX"), (3, None), (4, "..."), (5, "long long long long long long long long"
         " long long long long long long"), (6, "äöü ÉÀ 漢字"), (7, "one two three"), (7, "one two three"), (None, "no id here")]


def test_odd_rows_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", D.F.lit("clash"))
    named = [(("null" if i is None else i), t) for i, t in ITEMS]
    assert result(D.contamination(odd, items)) == brute([(i, t) for i, t, *_ in ODD], named)
    assert result(D.contamination(odd, items.limit(0))) == brute([(i, t) for i, t, *_ in ODD], [])
    assert D.contamination(empty, items).collect() == []


def test_separators_at_the_ends(spark):
    rows = [(1, "!! one two three", "en", "a"), (2, "one two three!!", "en", "a"), (3, "one two threes", "en", "a"),
            (4, "xone two three", "en", "a")]
    items = spark.createDataFrame([(1, "One two three.")], "item_id long, text string")
    assert result(D.contamination(documents(spark, rows), items)) == brute([(i, t) for i, t, *_ in rows], [(1, "One two three.")])


def test_proximity(spark):
    rows = [(1, "gamma beta x alpha delta", "en", "a"), (2, "alpha " + "x " * 40 + "beta gamma delta", "en", "a")]
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_near"], r["n_hit"]) for r in D.contamination(documents(spark, rows), items).collect()}
    assert got == {1: (1, 0), 2: (0, 0)}
