"""Message templates (F1): variable parts of a message become tokens.

Each rule is one ``regexp_replace`` (Java regex, JVM-side, codegen'd), so a
template costs a few regex passes per row and no Python.

Word boundaries are written as ASCII look-arounds instead of ``\\b``: the
reference's templates are defined on ASCII word characters (ECMAScript
always, the JVM since release 19), and a JVM-version-dependent ``\\b``
would change templates of text with accented letters next to digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from errorlens.functions._util import as_col, java_trim, js_trim

_NOT_WORD_BEFORE = r"(?<![0-9A-Za-z_])"
_NOT_WORD_AFTER = r"(?![0-9A-Za-z_])"

# The template rules, applied in this order.
UUID_RE = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
LONG_NUMBER_RE = _NOT_WORD_BEFORE + r"\d{6,}" + _NOT_WORD_AFTER
TIMESTAMP_RE = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
IP_RE = _NOT_WORD_BEFORE + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}" + _NOT_WORD_AFTER
EMAIL_RE = r"[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}"
DQUOTE_RE = r'"[^"]+"'
SQUOTE_RE = r"'[^']+'"
NUMBER_RE = _NOT_WORD_BEFORE + r"\d+" + _NOT_WORD_AFTER

UUID_TOKEN = "<UUID>"
ID_TOKEN = "<ID>"
TIMESTAMP_TOKEN = "<TIMESTAMP>"
IP_TOKEN = "<IP>"
EMAIL_TOKEN = "<EMAIL>"
DQUOTE_TOKEN = '"<STRING>"'
SQUOTE_TOKEN = "'<STRING>'"
NUMBER_TOKEN = "<NUM>"


def template_rules(mode: str = "core") -> list[tuple[str, str]]:
    """(pattern, replacement) pairs in application order for a mode."""
    _check_mode(mode)
    uuid = UUID_RE if mode == "core" else "(?i)" + UUID_RE
    rules = [
        (uuid, UUID_TOKEN),
        (LONG_NUMBER_RE, ID_TOKEN),
        (TIMESTAMP_RE, TIMESTAMP_TOKEN),
        (IP_RE, IP_TOKEN),
        (EMAIL_RE, EMAIL_TOKEN),
        (DQUOTE_RE, DQUOTE_TOKEN),
        (SQUOTE_RE, SQUOTE_TOKEN),
    ]
    if mode == "core":
        rules.append((NUMBER_RE, NUMBER_TOKEN))
    return rules


def normalize_message(message, mode: str = "core") -> Column:
    """message template; null message gives the empty string.

    core trims as Java does (chars up to U+0020), cloud as ECMAScript does
    (Unicode white space).
    """
    out = as_col(message)
    for pattern, token in template_rules(mode):
        out = F.regexp_replace(out, pattern, token)
    out = java_trim(out) if mode == "core" else js_trim(out)
    return F.coalesce(out, F.lit(""))


def _check_mode(mode: str) -> None:
    if mode not in ("core", "cloud"):
        raise ValueError(f"mode must be 'core' or 'cloud', not {mode!r}")
