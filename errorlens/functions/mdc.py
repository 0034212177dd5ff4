"""Context map columns (F10, F11): the ``k=v;k=v`` text form and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from errorlens.functions._util import as_col, let


def parse_mdc(text) -> Column:
    """``k=v;k=v`` text to ``map<string,string>``.

    Pairs are split on ``;`` and cut at the first ``=``; a pair whose ``=``
    is missing or first is dropped; a later key wins. Null or empty text
    gives null; text without a valid pair gives an empty map.
    """
    t = as_col(text)
    pairs = F.filter(F.split(t, ";", -1), lambda p: F.instr(p, "=") > 1)
    entries = F.transform(pairs, lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("key"),
        F.substr(p, F.instr(p, "=") + 1).alias("value")))
    # keep an entry only if its key does not come again later
    def last_wins(es):
        return F.filter(es, lambda e, i: ~F.exists(
            F.slice(es, i + 2, F.greatest(F.size(es) - i - 1, F.lit(0)).cast("int")),
            lambda later: later["key"] == e["key"]))
    to_map = let(entries, lambda es: let(last_wins(es), lambda kept: F.when(
        F.size(kept) > 0, F.map_from_entries(kept)).otherwise(
        F.create_map().cast("map<string,string>"))))
    return F.when(t.isNotNull() & (F.length(t) > 0), to_map)


def format_mdc(mdc) -> Column:
    """map to ``k=v;k=v`` with keys sorted; null or empty map -> null."""
    m = as_col(mdc)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return F.when(m.isNotNull() & (F.size(m) > 0), text)
