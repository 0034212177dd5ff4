import hashlib
import re

from corpus_rows import ODD
from errorlens.llm import secret_scan as S
from hypothesis import given, settings
from hypothesis import strategies as st

WORDS = r"(password|passwd|secret|token|api_?key)"


def brute_base(text):
    """The base spans by the definitions, without any pre-test."""
    found = [(m.start(), 0, m.end()) for m in
             re.finditer("(?a:(?i:" + WORDS + r"))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text)
             if len(m[2]) >= 6 and m[1].isascii()]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


PARTS = ["password", "PassWd", "API_KEY", "apikey", "secret", "token", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP",
         "0123456789abcdef", "abcdef12", "x", "é", "🙂", "\n", "ſecret", "toKen", "-----BEGIN RSA PRIVATE KEY-----"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans(text):
    assert [s for s in S.find(text) if s[1] < S.BASE] == brute_base(text)


def expected(text):
    base = [s for s in S.find(text or "") if s[1] < S.BASE]
    return hashlib.sha256(S.listed(base).encode()).hexdigest()


def test_every_path_gets_its_findings(odd, empty):
    rows = S.scan_documents(odd)[0].collect()
    assert len(rows) == len(ODD)
    want = sorted(((i, expected(t)) for i, t, *_ in ODD), key=repr)
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in rows), key=repr) == want
    five = next(r for r in rows if r["doc_id"] == 5)
    assert (five["n_assign"], five["n_access"], five["n_hex"]) == (1, 1, 0)
    assert five["spans"] == "assign:0:25,access:30:50"
    assert S.scan_documents(empty)[0].collect() == []


def test_seen_blobs_are_not_scanned_again(spark, odd, tmp_path):
    path = f"{tmp_path}/ledger"
    _, new = S.scan_documents(odd.where("doc_id < 6"))
    S.commit(path, new)
    ledger = spark.read.option("basePath", path).parquet(path).withColumn("rule_version", S.F.col("rule_version").cast("string"))
    out, more = S.scan_documents(odd, ledger)
    seen = {hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in ODD if i is not None and i < 6}
    assert not {r["blob"] for r in more.collect()} & seen
    assert out.count() == len(ODD)
    # a new rule version scans all blobs again
    again = S.scan_unseen(odd.select("doc_id", "text"), ledger, ["doc_id"], "2")
    assert again.count() == len({t or "" for _, t, *_ in ODD})
