import math
import re
from collections import Counter, defaultdict

from corpus_rows import ODD, SMALL, documents
from errorlens.llm import licenses as L
from errorlens.llm import lm_scores as M
from errorlens.llm import token_rollup as R


# ------------------------------------------------------------------ LM scores

def brute_lm(rows, target):
    """Every word and pair is in the tables of so small a corpus."""
    fold = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, fold(t)) for i, t, *_ in rows]
    pick = {"t": [w for i, w in docs if i in target], "b": [w for _, w in docs]}
    vocabulary = {w for x in pick["b"] for w in x}
    size, loss = len(vocabulary) + 2, {}
    for m, texts in pick.items():
        uni, pair, head = Counter(w for x in texts for w in x), Counter(), Counter()
        for x in texts:
            for a, b in zip([None, *x], x):
                pair[a, b] += 1
                head[a] += 1
        total = sum(uni.values())

        def p(a, b, uni=uni, pair=pair, head=head, total=total):
            base = (uni[b] + M.ADDED) / (total + M.ADDED * size)
            seen = max(head[a], uni[a] if a is not None else 0)
            if not seen:
                return base
            return M.BIGRAM * pair[a, b] / seen + (1 - M.BIGRAM * head[a] / seen) * base
        loss[m] = [sum(-math.log(p(a, b)) for a, b in zip([None, *x], x)) / max(1, len(x)) for _, x in docs]
    return sorted(((i, len(x), round(t, 6), round(b, 6), round(t - b, 6)) for (i, x), t, b in zip(docs, loss["t"], loss["b"])), key=repr)


def test_cross_entropy_difference(spark, odd, empty, monkeypatch):
    target = spark.createDataFrame([(1, "clash"), (5, "clash"), (5, "clash"), (None, "clash")], "doc_id long, text string")
    for at_once in (1 << 22, 3):
        monkeypatch.setattr(M, "TOKENS_AT_ONCE", at_once)
        got = M.cross_entropy_difference(odd, target).collect()
        rounded = sorted(((r[0], r[1], round(r[2], 6), round(r[3], 6), round(r[4], 6)) for r in got), key=repr)
        want = brute_lm(ODD, {1, 5})
        for a, b in zip(rounded, want):
            assert a[:2] == b[:2] and all(abs(x - y) < 1e-4 for x, y in zip(a[2:], b[2:])), (a, b)
    assert M.cross_entropy_difference(empty, target).collect() == []
    assert M.cross_entropy_difference(odd, target.limit(0)).count() == len(ODD)


def test_target_texts_score_lower(spark):
    rows = [(i, ("red green blue paint " if i % 2 else "wheat corn rice field ") * 5 + f"w{i}", "en", "s") for i in range(60)]
    target = spark.createDataFrame([(i,) for i in range(1, 30, 2)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in M.cross_entropy_difference(documents(spark, rows), target).collect()}
    assert max(got[i] for i in range(1, 60, 2)) < min(got[i] for i in range(0, 60, 2))


def test_the_tables_are_bounded_by_their_share(spark, monkeypatch):
    monkeypatch.setattr(M, "VOCABULARY_BITS", 3)
    monkeypatch.setattr(M, "TABLE_BITS", 3)
    rows = [(i, "common words " * 5 + f"rare{i} odd{i}", "en", "s") for i in range(40)]
    marked = M.with_target(documents(spark, rows), spark.createDataFrame([(1,)], "doc_id long"))
    models = M.fit(marked)
    assert models.ids.size == 2 + 2 and len(models.pairs) <= 8
    assert M.scored(marked, models).count() == 40


def test_rare_words_and_pairs_count(spark):
    """A word seen once or twice among over 2**20 tokens, and a pair seen once."""
    rows = [(i, " ".join(f"w{i * 39_000 + k} common" if k % 30 == 0 else f"w{i * 39_000 + k}" for k in range(40_000)), "en", "s")
            for i in range(30)]
    got = M.cross_entropy_difference(documents(spark, rows), spark.createDataFrame([(3,), (4,)], "doc_id long")).collect()
    want = {w[0]: w for w in brute_lm(rows, {3, 4})}
    assert len(got) == len(want) == 30
    for r in got:
        assert r[1] == want[r[0]][1] and all(abs(x - y) < 1e-5 for x, y in zip(r[2:], want[r[0]][2:])), (r, want[r[0]])


# -------------------------------------------------------------------- rollups

WORDS = {"words-1": R.word_counter()}


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"], r["chars"]) for r in rollup.totals().collect()}


def brute_rollup(rows, count):
    first = {}
    for i, t, lang, source in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3] or "", r[2] or "")):
        first.setdefault(t or "", (source, lang))
    out = defaultdict(lambda: [0, 0, 0])
    for t, (source, lang) in first.items():
        t = "\n".join(dict.fromkeys(t.split("\n")))
        x = out[source, lang, "words-1"]
        x[0], x[1], x[2] = x[0] + 1, x[1] + count(t), x[2] + len(t)
    return {k: tuple(v) for k, v in out.items()}


def test_life_of_a_corpus(spark, small, odd, empty, tmp_path):
    count = lambda t: len(t.encode().split())
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in small.collect()]
    r = R.corpus_rollup(small, f"{tmp_path}/small", WORDS)
    assert totals(r) == brute_rollup(rows, count) and r.committed() == [1, 2, 3]
    # after batch 1 the table itself
    plain = {}
    for x in small.collect():
        at, t = plain.setdefault((x["source"], x["lang"], "words-1"), [0, 0, 0]), x["text"] or ""
        at[0], at[1], at[2] = at[0] + 1, at[1] + count(t), at[2] + len(t)
    first = r.totals_by_batch().where("batch = 1").collect()
    assert {(x["source"], x["lang"], x["tokenizer"]): [x["documents"], x["tokens"], x["chars"]] for x in first} == plain
    assert totals(R.corpus_rollup(odd, f"{tmp_path}/odd", WORDS)) == brute_rollup(ODD, count)
    assert totals(R.corpus_rollup(empty, f"{tmp_path}/empty", WORDS)) == {}


def test_commits_are_idempotent(spark, odd, tmp_path):
    r = R.Rollup(spark, f"{tmp_path}/r")
    assert totals(r) == {}
    counts = R.token_counts(odd, WORDS)
    assert r.commit(1, R.signed(counts, 1)) and not r.commit(1, R.signed(counts, 1))
    before = totals(r)
    # a commit that was stopped half way counts nothing and can be made again
    R.summed(R.signed(counts, 1)).write.parquet(f"{r.path}/batch=2")
    (tmp_path / "r" / "batch=2" / "_SUCCESS").unlink()
    assert totals(r) == before
    assert r.commit(2, R.signed(counts, -1)) and totals(r) == {}
    r.commit(3, R.signed(counts, 1))
    r.fold(4)
    assert totals(r) == before and r.committed() == [4]


def test_bpe_counts(spark):
    make = R.bpe_counter()
    assert make()(["", "Hello world", "Hello  world's 12"]) == [0, 2, 5]


# ------------------------------------------------------------------- licenses

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def whole_places(rows, notices):
    out = set()
    for i, t, *_ in rows:
        w = split(t)
        for name, text in notices.items():
            x = split(text)
            out |= {(i, name, a) for a in range(len(w) - len(x) + 1) if x and w[a:a + len(x)] == x}
    return out


def places(df):
    return {(r["doc_id"], r["license"], r["start"]) for r in df.collect()}


def test_planted_notices(spark, small):
    got = L.license_matches(small, L.templates(spark))
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert places(got) == whole_places(rows, L.NOTICES) and got.count()


def test_every_offset_edits_and_repeats(spark):
    filler = [f"w{k}" for k in range(60)]
    rows = []
    for name, text in L.NOTICES.items():
        for at in (0, 1, 7, 16, 33, 60):
            rows.append((len(rows), " ".join(filler[:at] + [text] + filler[at:]), "en", name))
    got = places(L.license_matches(documents(spark, rows), L.templates(spark)))
    assert whole_places(rows, L.NOTICES) <= got
    grant = L.NOTICES["MIT-grant"].split()
    edited, broken = grant.copy(), grant.copy()
    edited[20] = "XX"
    for k in (5, 15, 25, 35):
        broken[k] = "XX"
    odd = [(1, " ".join(edited), "en", "s"), (2, " ".join(broken), "en", "s"), (3, " ".join(grant + grant), "en", "s")]
    found = L.license_matches(documents(spark, odd), L.templates(spark)).collect()
    n = len(split(" ".join(grant))) - 4
    one = next(r for r in found if r["doc_id"] == 1)
    assert abs(one["containment"] - (n - 5) / n) < 1e-9 and (one["start"], one["n_words"]) == (0, n + 4)
    assert not any(r["doc_id"] == 2 for r in found)
    assert sorted(r["start"] for r in found if r["doc_id"] == 3) == [0, n + 4]


def test_odd_rows_and_empty_tables(spark, odd, empty):
    marks = spark.createDataFrame([("none", None), ("blank", "..."), ("short", "no id"), ("long", "long " * 30),
                                   ("six", "one two three four five six")], "license string, text string")
    got = places(L.license_matches(odd, marks))
    assert {(1, "six", 0), (7, "six", 0), (None, "short", 0)} <= got and not {x for x in got if x[1] in ("none", "blank")}
    assert L.license_matches(odd, marks.limit(0)).collect() == [] and L.license_matches(empty, marks).collect() == []
