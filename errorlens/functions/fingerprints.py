"""Grouping keys (F6) and cluster ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from errorlens.functions._util import as_col, let
from errorlens.functions.levels import has_stack_trace
from errorlens.functions.templates import normalize_message
from errorlens.functions.traces import (_exception_class_only, _kept, _classified, _frames_of,
                                        _lines, _outer_items, cloud_frames,
                                        top_user_frames)
from errorlens.functions._util import java_trim


def frame_key(frame) -> Column:
    """``class.method:line`` of a parsed frame."""
    f = as_col(frame)
    return F.concat(f["class_name"], F.lit("."), f["method_name"], F.lit(":"),
                    f["line_number"].cast("string"))


def location_key(class_name="class_name", method_name="method_name",
                 line_number="line_number") -> Column:
    """``class`` + ``.method`` + ``:line``, each part only when present."""
    c, m, l = as_col(class_name), as_col(method_name), as_col(line_number)
    return F.concat(F.coalesce(c, F.lit("")),
                    F.coalesce(F.concat(F.lit("."), m), F.lit("")),
                    F.coalesce(F.concat(F.lit(":"), l.cast("string")), F.lit("")))


def trace_key(trace, frames: int = 5) -> Column:
    """core: exception class then ``|class.method:line`` for the first user
    frames of the outermost exception. Null when the trace does not parse."""
    def on_lines(ls):
        cls = _exception_class_only(java_trim(F.element_at(ls, 1)))
        outer = _frames_of(_outer_items(_kept(_classified(ls))))
        keys = F.transform(top_user_frames(outer, frames),
                           lambda f: F.concat(F.lit("|"), frame_key(f)))
        return F.when(ls.isNotNull(), F.concat(F.coalesce(cls, F.lit("Unknown")),
                                               F.array_join(keys, "")))
    return let(_lines(as_col(trace)), on_lines)


def fingerprint(mode: str = "core", frames: int = 5, trace="stack_trace",
                class_name="class_name", method_name="method_name",
                line_number="line_number", message="message") -> Column:
    """the grouping key of an error row.

    core: trace key when a trace is present and parses; else the location
    key when not empty; else the message template.
    cloud: the first user frames found anywhere in the trace joined by
    ``|``; else class, method and line (empty text and line 0 count as
    missing) joined by ``|``; else the template of the message, ``unknown``
    standing in for a null or empty message.
    """
    t = as_col(trace)
    if mode == "core":
        tk = F.when(has_stack_trace(t), trace_key(t, frames))
        loc = let(location_key(class_name, method_name, line_number),
                  lambda x: F.when(x != "", x))
        return F.coalesce(tk, loc, normalize_message(message, "core"))
    if mode != "cloud":
        raise ValueError(f"mode must be 'core' or 'cloud', not {mode!r}")
    found = let(F.when(has_stack_trace(t), cloud_frames(t, frames)),
                lambda xs: F.when(F.size(xs) > 0, F.array_join(xs, "|")))
    c, m, l = as_col(class_name), as_col(method_name), as_col(line_number)
    parts = let(F.concat_ws("|", F.when(F.length(c) > 0, c), F.when(F.length(m) > 0, m),
                            F.when(l != 0, l.cast("string"))),
                lambda x: F.when(x != "", x))
    msg = as_col(message)
    msg = F.when(msg.isNull() | (F.length(msg) == 0), F.lit("unknown")).otherwise(msg)
    return F.coalesce(found, parts, normalize_message(msg, "cloud"))


def cluster_id(fp) -> Column:
    """``ERR-`` and 8 upper hex digits of the Java string hash of the
    fingerprint (UTF-16 code units, 32-bit wrap-around). Text inside the
    Basic Multilingual Plane hashes its chars directly; text with chars
    beyond it goes through its UTF-16 encoding."""
    def step(acc, unit):
        return (acc * 31 + unit) % F.lit(4294967296)

    def on_fp(f):
        chars = F.aggregate(F.transform(F.split(f, ""), lambda c: F.ascii(c).cast("bigint")),
                            F.lit(0).cast("bigint"), step)
        # UTF-16 code units as 4-hex-digit chunks
        units = F.split(F.hex(F.encode(f, "UTF-16BE")), r"(?<=\G.{4})", -1)
        coded = F.aggregate(F.filter(units, lambda u: F.length(u) == 4), F.lit(0).cast("bigint"),
                            lambda acc, u: step(acc, F.conv(u, 16, 10).cast("bigint")))
        h = F.when(f.rlike(r"[\x{10000}-\x{10FFFF}]"), coded).otherwise(chars)
        return F.when(f.isNotNull(), F.format_string("ERR-%08X", h))
    return let(as_col(fp), on_fp)


def java_hash_id(text: str) -> str:
    """Driver-side F7 for a literal parameter (a cluster id to look up)."""
    h = 0
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (h * 31 + (data[i] << 8 | data[i + 1])) % 4294967296
    return f"ERR-{h:08X}"
