from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


# Java's String.trim: drops every char at or below U+0020 at both ends.
JAVA_TRIM_RE = r"\A[\x00-\x20]+|[\x00-\x20]+\z"

# ECMAScript String.prototype.trim: white space and line terminators.
JS_SPACE_CHARS = (r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}")
JS_SPACE_CLASS = f"[{JS_SPACE_CHARS}]"
JS_TRIM_RE = rf"\A{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+\z"


# Every char Java's trim drops, for Spark's trim(str, chars) (no regex).
JAVA_TRIM_CHARS = "".join(chr(i) for i in range(0x21))


def java_trim(c) -> Column:
    return F.trim(as_col(c), F.lit(JAVA_TRIM_CHARS))


JS_EXTRA_SPACE_CLASS = (r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
                        r"\x{3000}\x{FEFF}]")


def js_trim(c) -> Column:
    """ECMAScript trim. Text without the non-ASCII white space takes Spark's
    char trim (no regex); only text holding such chars takes the regex."""
    x = as_col(c)
    return F.when(x.rlike(JS_EXTRA_SPACE_CLASS), F.regexp_replace(x, JS_TRIM_RE, "")).otherwise(
        F.trim(x, F.lit("\t\n\x0b\x0c\r ")))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst copies an aliased expression into every place that refers to
    it (filter pushdown, project collapsing, lambdas), so an expensive
    expression used several times would run several times per row. Binding
    it as the element of a one-element array makes every use a cheap
    variable reference.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
