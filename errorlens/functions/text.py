"""Display columns (F15, F17) and text lookbacks."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from errorlens.functions._util import as_col


def preview(text, n: int = 60, null_text: str | None = None) -> Column:
    """the text when it has at most ``n`` chars, else its first
    ``n - 3`` chars and ``...``. Null stays null unless ``null_text``."""
    t = as_col(text)
    out = F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 3), F.lit("...")))
    return F.coalesce(out, F.lit(null_text)) if null_text is not None else out


def format_count(count) -> Column:
    """``x.xM`` from a million, ``x.xK`` from a thousand, else the
    number. One decimal, rounded half up on the exact value (integer
    arithmetic, so no binary rounding)."""
    c = as_col(count).cast("bigint")

    def scaled(unit: int, suffix: str) -> Column:
        tenths = F.floor((c * 10 + unit // 2) / unit).cast("bigint")
        return F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."),
                        (tenths % 10).cast("string"), F.lit(suffix))

    return (F.when(c >= 1_000_000, scaled(1_000_000, "M"))
            .when(c >= 1_000, scaled(1_000, "K"))
            .otherwise(c.cast("string")))


_LOOKBACK = re.compile(r"([0-9]+)([smhd])")
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def parse_lookback(text: str | None, default: timedelta) -> timedelta:
    """P6 parameter: ``(\\d+)([smhd])``, lower-cased, whole string; anything
    else is ``default``."""
    if text is None:
        return default
    m = _LOOKBACK.fullmatch(text.lower())
    if not m:
        return default
    return timedelta(**{_UNITS[m.group(2)]: int(m.group(1))})
