"""Model answer columns (L6-L11): sections, confidence, patches.

All regex work is JVM-side. core follows the Java rules (case-blind
sections, ``$`` may end before a final line break, Java trim); cloud the
ECMAScript ones (case-sensitive, ``$`` only at the very end, Unicode trim,
empty text reads as null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from errorlens.functions._util import JS_SPACE_CLASS, as_col, java_trim, js_trim, let

# Section markers of an answer.
MARKERS = ["EXPLANATION:", "ROOT_CAUSE:", "RECOMMENDATION:", "PATCH:"]
REFUSALS_CORE = ["no code changes needed", "not applicable"]
REFUSALS_PATCH = ["no code changes", "not applicable"]


def _section_re(name: str, mode: str) -> str:
    others = "|".join(m for m in MARKERS if m != f"{name}:")
    if mode == "core":
        return rf"(?is){name}:\s*(.+?)(?={others}|$)"
    return rf"(?s){name}:{JS_SPACE_CLASS}*(.+?)(?={others}|\z)"


def _patch_re(mode: str) -> str:
    if mode == "core":
        return r"(?is)PATCH:\s*```(?:diff)?\s*(.+?)```"
    return rf"(?s)PATCH:{JS_SPACE_CLASS}*```(?:diff)?{JS_SPACE_CLASS}*(.+?)```"


def _extract(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def _extract_nonempty(text: Column, pattern: str) -> Column:
    """Group 1 of a pattern whose group cannot be empty: one regex pass,
    no match reads as null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def section(text, name: str, mode: str = "core") -> Column:
    """One trimmed section of an answer (null when absent)."""
    t = as_col(text)
    raw = _extract_nonempty(t, _section_re(name, mode))
    if mode == "core":
        return java_trim(raw)
    return let(js_trim(raw), lambda x: F.when(F.length(x) > 0, x))


def _contains_any_lower(x: Column, words) -> Column:
    low = F.lower(x)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def response_patch(text, mode: str = "core") -> Column:
    """The ``PATCH:`` fenced block of an answer. core drops a block that
    says no change is needed or not applicable; cloud keeps it."""
    t = as_col(text)
    raw = _extract_nonempty(t, _patch_re(mode))
    if mode == "core":
        return let(java_trim(raw), lambda p: F.when(~_contains_any_lower(p, REFUSALS_CORE), p))
    return let(js_trim(raw), lambda p: F.when(F.length(p) > 0, p))


def parse_response(text, mode: str = "core") -> Column:
    """``struct<explanation, root_cause, recommendation, patch>``."""
    return F.struct(
        section(text, "EXPLANATION", mode).alias("explanation"),
        section(text, "ROOT_CAUSE", mode).alias("root_cause"),
        section(text, "RECOMMENDATION", mode).alias("recommendation"),
        response_patch(text, mode).alias("patch"))


def confidence(text, mode: str = "core") -> Column:
    """Answer grade. core: one point per marker present, per length
    over 500 and over 1000, and for a code fence; 6 HIGH, 4 MEDIUM, 2 LOW.
    cloud: one point per section found, per length over 500 and 1000;
    5 HIGH, 3 MEDIUM, 1 LOW."""
    t = as_col(text)
    n = F.length(t)
    if mode == "core":
        pts = [F.contains(t, F.lit(m)) for m in MARKERS] + [n > 500, n > 1000, F.contains(t, F.lit("```"))]
        score = sum((p.cast("int") for p in pts), F.lit(0))
        grade = (F.when(score >= 6, "HIGH").when(score >= 4, "MEDIUM")
                 .when(score >= 2, "LOW").otherwise("UNKNOWN"))
        return F.when(t.isNull() | (n == 0), F.lit("UNKNOWN")).otherwise(grade)
    pts = [t.rlike(_section_re(s, "cloud")) for s in ("EXPLANATION", "ROOT_CAUSE", "RECOMMENDATION")]
    pts += [t.rlike(_patch_re("cloud")), n > 500, n > 1000]
    score = sum((F.coalesce(p, F.lit(False)).cast("int") for p in pts), F.lit(0))
    return (F.when(score >= 5, "HIGH").when(score >= 3, "MEDIUM")
            .when(score >= 1, "LOW").otherwise("UNKNOWN"))


def has_patch(patch, mode: str = "core") -> Column:
    """A patch is there. cloud also rejects "no code changes"."""
    p = as_col(patch)
    base = p.isNotNull() & (F.length(p) > 0)
    if mode == "core":
        return base
    return base & ~F.contains(F.lower(p), F.lit("no code changes"))


def is_valid_diff(patch) -> Column:
    """At least 20 chars with ``---``, ``+++``, ``@@`` and a changed
    line (a line starting with ``+`` or ``-`` after the first)."""
    p = as_col(patch)
    return F.coalesce(
        (F.length(p) >= 20) & F.contains(p, F.lit("---")) & F.contains(p, F.lit("+++"))
        & F.contains(p, F.lit("@@")) & (F.contains(p, F.lit("\n+")) | F.contains(p, F.lit("\n-"))),
        F.lit(False))


def _format_patch(p: Column) -> Column:
    lf = F.regexp_replace(p, r"\r\n", "\n")
    return let(lf, lambda x: F.when(x.endswith("\n"), x).otherwise(F.concat(x, F.lit("\n"))))


# Forms of a diff in an answer.
CLOUD_BLOCK_RE = r"```(?:diff)?" + JS_SPACE_CLASS + r"*([\s\S]*?)```"
CLOUD_DIFF_RE = r"((?:---[\s\S]*?\+\+\+[\s\S]*?@@[\s\S]+))"
CORE_BLOCK_RE = r"(?s)```(?:diff)?\s*(.+?)```"


def extract_patch(text, mode: str = "core") -> Column:
    """A patch from a free answer.

    core: the first fenced block, trimmed, longer than 10 chars and not a
    refusal. cloud: the first fenced block if it is a valid diff, else the
    first ``--- ... +++ ... @@ ...`` run if valid, else the whole trimmed
    answer if it holds all three markers; CRLF becomes LF and a final line
    break is added.
    """
    t = as_col(text)
    if mode == "core":
        block = java_trim(_extract_nonempty(t, CORE_BLOCK_RE))
        return let(block, lambda b: F.when(
            ~_contains_any_lower(b, REFUSALS_PATCH) & (F.length(b) > 10), b))
    block = js_trim(_extract(t, CLOUD_BLOCK_RE))
    bare = js_trim(_extract_nonempty(t, CLOUD_DIFF_RE))
    whole = F.when(F.contains(t, F.lit("---")) & F.contains(t, F.lit("+++")) & F.contains(t, F.lit("@@")),
                   js_trim(t))
    pick = (F.when(is_valid_diff(block), block)
            .when(is_valid_diff(bare), bare)
            .otherwise(whole))
    return let(pick, lambda p: F.when(p.isNotNull(), _format_patch(p)))


def patch_target(patch) -> Column:
    """The file a patch changes, from its first ``+++`` line."""
    p = as_col(patch)
    line = F.regexp_extract(p, r"(?m)^(\+\+\+ .*)$", 1)
    path = F.substr(line, F.instr(line, " ") + 1)
    path = F.when(path.startswith("b/"), F.substr(path, F.lit(3))).otherwise(path)
    return F.when(F.length(line) > 0, java_trim(path))


def patch_file_name(file_name, cluster_id, mode: str = "core") -> Column:
    """``<base>_<id>.diff``. core: every ``.java`` removed from the file
    name (``unknown`` when null) and the whole id. cloud: the first
    ``.java`` removed (``unknown`` when that leaves nothing) and the first
    8 chars of the id."""
    f, cid = as_col(file_name), as_col(cluster_id)
    if mode == "core":
        base = F.coalesce(F.replace(f, F.lit(".java"), F.lit("")), F.lit("unknown"))
        return F.concat(base, F.lit("_"), cid, F.lit(".diff"))
    pos = F.instr(f, ".java")
    first_cut = F.when(pos > 0, F.concat(F.substr(f, F.lit(1), pos - 1), F.substr(f, pos + 5))).otherwise(f)
    base = let(first_cut, lambda b: F.when(F.length(b) > 0, b).otherwise(F.lit("unknown")))
    return F.concat(base, F.lit("_"), F.substr(cid, F.lit(1), F.lit(8)), F.lit(".diff"))


def add_diff_header(patch, file_name) -> Column:
    """Add ``--- a/f`` and ``+++ b/f`` unless both markers are there."""
    p, f = as_col(patch), as_col(file_name)
    return F.when(F.contains(p, F.lit("---")) & F.contains(p, F.lit("+++")), p).otherwise(
        F.concat(F.lit("--- a/"), f, F.lit("\n+++ b/"), f, F.lit("\n"), p))
