"""Secret scans: an incremental blob ledger.

Every version of every path is content-addressed. Only pairs of a blob and
a rule version that the ledger hasn't seen are scanned; the findings are
kept in the ledger and joined back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow

#: Rules of version 1. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE = 3
RULE_VERSION = "1"

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
                    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
RUN = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
LONG_HEX = b"\x01" * 24


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret of a text, in code points,
    by start, then kind. Cheap byte tests decide which rules have to run;
    they never rule out a match."""
    raw, out = text.encode("utf-8", "surrogatepass"), []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if LONG_HEX in raw.translate(RUN):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    if b"PRIVATE KEY-----" in raw:
        out += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    if b"eyJ" in raw:
        out += [(m.start(), 4, m.end()) for m in JWT.finditer(text)]
    return sorted(out)


def listed(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batch: pa.RecordBatch) -> dict:
    found = [find(t) for t in batch.column("text").to_pylist()]
    base = [[s for s in f if s[1] < BASE] for f in found]
    count = lambda k: pa.array([sum(s[1] == k for s in f) for f in base], pa.int64())
    return {"blob": batch.column("blob"), "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
            "base_sha256": pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base]),
            "spans": pa.array([listed(f) for f in found])}


FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def content_addressed(versions: DataFrame, path: Sequence[str]) -> DataFrame:
    """``path`` columns, text (null: empty) and ``blob``, the SHA-256 of the
    text, of every row of ``versions``; each row is a version of a path."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return versions.select(*path, text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, path: Sequence[str],
                rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, findings, rule_version) for the blobs of
    ``versions`` that ``ledger`` has not at ``rule_version``. A blob held by
    many paths is scanned once: one path stands for it."""
    rows = content_addressed(versions, path)
    todo = (rows.select(*path, "blob").groupBy("blob")
            .agg(F.min(F.struct(*path)).alias("_at")))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        todo = todo.join(seen, "blob", "left_anti")
    todo = todo.select(F.col("blob").alias("_blob"), *[F.col(f"_at.{c}").alias(f"_{c}") for c in path])
    same = F.col("blob") == F.col("_blob")
    for c in path:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    texts = rows.join(todo, same).select("blob", "text")
    found = map_arrow(texts, _scan, FINDINGS)
    return found.withColumn("rule_version", F.lit(rule_version)).dropDuplicates(["blob", "rule_version"])


def commit(ledger_path: str, found: DataFrame) -> None:
    """Add ledger rows to the ledger folder (one folder per rule version)."""
    found.write.mode("append").partitionBy("rule_version").parquet(ledger_path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, path: Sequence[str],
                     rule_version: str = RULE_VERSION) -> DataFrame:
    """Every path with the findings of its blob. A blob that many paths hold
    is a skewed join key, which adaptive execution splits."""
    rows = content_addressed(versions, path).drop("text")
    now = ledger.where(F.col("rule_version") == rule_version).drop("rule_version")
    return rows.join(now, "blob")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings by document, new ledger rows) of a table of documents.

    Every row is a version of the path doc_id. Null text is empty; empty
    text has no spans; repeated rows are scanned once and each is returned;
    null ids are kept. Columns besides doc_id and text are ignored."""
    versions = docs.select("doc_id", "text")
    new = checkpoint(scan_unseen(versions, ledger, ["doc_id"]))
    whole = new if ledger is None else ledger.unionByName(new)
    out = findings_by_path(versions, whole, ["doc_id"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob"), new


def _sql() -> str:
    """`scan_documents` in DuckDB. A kind's matches stand between the pieces
    that splitting at its pattern leaves, so lengths give their places. Runs of
    hex digits and of access keys are maximal, so their least lengths can be
    asked for by the pattern."""
    q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    rules = [(ASSIGN.pattern, 2, "length(g) >= 6"), (ACCESS.pattern, 0, "length(m) >= 20"), ("[0-9a-f]{24,}", 0, "true"),
             (PEM.pattern, 0, "true"), (JWT.pattern, 0, "true")]
    parts = " UNION ALL ".join(
        f"SELECT blob, text, {k} AS k, {q(KINDS[k])} AS kind, string_split_regex(text, {q(p)}) AS gaps, "
        f"regexp_extract_all(text, {q(p)}) AS ms, regexp_extract_all(text, {q(p)}, {g}) AS gs FROM blobs "
        f"WHERE regexp_matches(text, {q(p)})" for k, (p, g, _) in enumerate(rules))
    taken = " OR ".join(f"(k = {k} AND {cond})" for k, (_, _, cond) in enumerate(rules))
    joined = lambda where: (f"coalesce(string_agg(kind || ':' || a || ':' || (a + length(m)), ',' ORDER BY a, k) "  # noqa: E731
                            f"FILTER (WHERE {where}), '')")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
blobs AS (SELECT DISTINCT sha256(text) AS blob, text FROM docs),
parts AS ({parts}),
places AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM parts),
found AS (SELECT blob, k, kind, ms[i] AS m, gs[i] AS g,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
    FROM places),
kept AS (SELECT * FROM found WHERE {taken}),
by_blob AS (SELECT blob, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
    count(*) FILTER (WHERE k = 2) AS n_hex, {joined(f"k < {BASE}")} AS base, {joined("true")} AS spans FROM kept GROUP BY blob)
SELECT d.doc_id, coalesce(b.n_assign, 0) AS n_assign, coalesce(b.n_access, 0) AS n_access, coalesce(b.n_hex, 0) AS n_hex,
    sha256(coalesce(b.base, '')) AS base_sha256, coalesce(b.spans, '') AS spans, sha256(d.text) AS blob
FROM docs d LEFT JOIN by_blob b ON b.blob = sha256(d.text)"""


SQL = _sql()
