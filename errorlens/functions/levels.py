"""Log level columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from errorlens.functions._util import as_col
from errorlens.schema import ERROR_LEVELS, LEVELS


def normalize_level(level) -> Column:
    """Canonical level name.

    Case-blind; null or empty reads as INFO; WARNING is WARN, SEVERE is
    ERROR; anything else unknown is INFO.
    """
    up = F.upper(as_col(level))
    return (F.when(up.isin(*LEVELS), up)
            .when(up == "WARNING", F.lit("WARN"))
            .when(up == "SEVERE", F.lit("ERROR"))
            .otherwise(F.lit("INFO")))


def level_rank(level) -> Column:
    """Rank of a canonical level, TRACE 0 to FATAL 5; null for other text."""
    c = as_col(level)
    expr = F.when(c == LEVELS[0], F.lit(0))
    for i, name in enumerate(LEVELS[1:], start=1):
        expr = expr.when(c == name, F.lit(i))
    return expr


def at_least(level, threshold: str = "WARN") -> Column:
    """Predicate, canonical level ranks at or above ``threshold``.

    Written as an ``isin`` on the names, so the scan can push it down.
    """
    threshold = threshold.upper()
    return as_col(level).isin(*LEVELS[LEVELS.index(threshold):])


def is_error(level="level") -> Column:
    """Predicate, canonical level is ERROR or FATAL (pushable)."""
    return as_col(level).isin(*ERROR_LEVELS)


def has_stack_trace(trace="stack_trace") -> Column:
    """Trace present and not empty (null-safe: false for null)."""
    c = as_col(trace)
    return c.isNotNull() & (F.length(c) > 0)
