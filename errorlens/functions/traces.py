"""Stack trace columns.

A trace is parsed by array functions over its lines, not by a UDF: each line
is classified once (cause header, "... n more", frame, other), the first
"other" line ends the parse, and cause headers cut the kept lines into
segments. The recursive cause chain of the reference becomes a flat array
``causes`` ordered from the outermost cause to the root cause.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from errorlens.functions._util import JS_SPACE_CHARS, as_col, java_trim, js_trim, let

# Line grammar of a Java stack trace.
EXCEPTION_RE = r"\A([\w.$]+(?:Exception|Error|Throwable))(?::\s*(.*))?\z"
EXCEPTION_NO_MESSAGE_RE = r"\A[\w.$]+(?:Exception|Error|Throwable)\z"
# A frame, on the untrimmed line: trimmed it starts with "at" and ends with
# ")", so the trimmed chars are exactly the runs matched here.
RAW_FRAME_RE = r"\A[\x00-\x20]*at\s+([\w.$]+)\.([\w$<>]+)\(([^)]+)\)[\x00-\x20]*\z"
CAUSE_RE = r"\ACaused by:\s*(.+)\z"
MORE_RE = r"\A\s*\.\.\.\s*(\d+)\s+more\s*\z"
LINE_SPLIT_RE = r"\r?\n"
TRAILING_NEWLINES_RE = r"(\r?\n)+\z"

# Class-name prefixes of framework code. core: 14, cloud: 10.
CORE_FRAMEWORK_PREFIXES = [
    "java.", "javax.", "sun.", "com.sun.", "jdk.",
    "org.springframework.", "org.apache.", "org.hibernate.",
    "org.slf4j.", "ch.qos.logback.", "com.zaxxer.hikari.", "io.netty.",
    "reactor.", "com.fasterxml.jackson.",
]
CLOUD_FRAMEWORK_PREFIXES = [
    "java.", "javax.", "sun.", "com.sun.", "jdk.",
    "org.springframework.", "org.apache.", "org.hibernate.",
    "org.slf4j.", "ch.qos.logback.",
]

# cloud: a frame anywhere in a line, as "name(location)".
# ECMAScript \s is Unicode white space, so the class is spelled out.
CLOUD_FRAME_RE = rf"at[{JS_SPACE_CHARS}]+([^{JS_SPACE_CHARS}]+)\(([^)]+)\)"
CLOUD_EXCEPTION_RE = r"\A([A-Za-z0-9_.]+(?:Exception|Error|Throwable))"


def framework_regex(mode: str = "core") -> str:
    prefixes = CORE_FRAMEWORK_PREFIXES if mode == "core" else CLOUD_FRAMEWORK_PREFIXES
    return r"\A(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"


def is_framework(class_name, mode: str = "core") -> Column:
    """class is framework code (null class counts as framework)."""
    c = as_col(class_name)
    return F.coalesce(c.rlike(framework_regex(mode)), F.lit(True))


# ---------------------------------------------------------------- frames

def parse_frame(line) -> Column:
    """one frame line to ``struct<class_name, method_name, file_name,
    line_number, native>``; null when the line is not a frame.

    Location: ``Native Method`` (native, no file), ``Unknown Source`` (no
    file), ``Name.java:n``, else the whole text as file; line -1 if unknown.
    """
    l = as_col(line)
    return _frame_struct(l, l.rlike(RAW_FRAME_RE))


# One pass over a raw frame line gives class, method and either the
# ``Name.java:n`` location split in two or any other location whole.
_RAW_FRAME_PARTS_RE = (r"\A[\x00-\x20]*at\s+([\w.$]+)\.([\w$<>]+)\("
                       r"(?:(\w+\.java):(\d+)|([^)]+))\)[\x00-\x20]*\z")


def _frame_struct(raw: Column, is_frame: Column) -> Column:
    """Frame fields of a raw frame line: one regex pass rewrites the line to
    ``class \\x01 method \\x01 file \\x01 line \\x01 other location``
    (empty parts where a group did not take part), then one split (at most
    5 parts, so a location holding the separator stays whole)."""
    def build(parts):
        file_part, other = parts[2], parts[4]
        has_line = F.length(file_part) > 0
        file_name = (F.when(has_line, file_part)
                     .when(other.isin("Native Method", "Unknown Source"), F.lit(None).cast("string"))
                     .otherwise(other))
        line_no = F.when(has_line, parts[3].try_cast("int"))
        return F.struct(
            parts[0].alias("class_name"), parts[1].alias("method_name"),
            file_name.alias("file_name"),
            F.coalesce(line_no, F.lit(-1)).alias("line_number"),
            (~has_line & (other == "Native Method")).alias("native"),
        )
    split = F.split(F.regexp_replace(raw, _RAW_FRAME_PARTS_RE, "$1\u0001$2\u0001$3\u0001$4\u0001$5"),
                    "\u0001", 5)
    return F.when(is_frame, let(split, build))


# ---------------------------------------------------------------- header

def _exception_head(raw: Column) -> Column:
    """``struct<cls, msg>`` of an exception line (first line or cause).

    The full pattern is tried on the trimmed text; the colon split is done
    on the text as given.
    """
    def on_raw(r):
        def on_trimmed(t):
            full = t.rlike(EXCEPTION_RE)
            colon = F.instr(r, ":")
            cls = (F.when(full, F.regexp_extract(t, EXCEPTION_RE, 1))
                   .when(colon > 1, java_trim(F.substring_index(r, ":", 1)))
                   .otherwise(t))
            msg = (F.when(full, F.when(t.rlike(EXCEPTION_NO_MESSAGE_RE), F.lit(None).cast("string"))
                          .otherwise(F.regexp_extract(t, EXCEPTION_RE, 2)))
                   .when(colon > 1, java_trim(F.substr(r, colon + 1)))
                   .otherwise(F.lit(None).cast("string")))
            return F.struct(cls.alias("cls"), msg.alias("msg"))
        return let(java_trim(r), on_trimmed)
    return let(raw, on_raw)


def _exception_class_only(raw: Column) -> Column:
    """The class part of :func:`_exception_head` in one regex pass: the full
    pattern rewritten to its class differs from the text exactly when it
    matched with a message part; when it matched without one the text is
    the class and has no colon, so the colon rule gives the same answer."""
    def on_raw(r):
        def on_trimmed(t):
            rewritten = F.regexp_replace(t, EXCEPTION_RE, "$1")
            return (F.when(rewritten != t, rewritten)
                    .when(F.instr(r, ":") > 1, java_trim(F.substring_index(r, ":", 1)))
                    .otherwise(t))
        return let(java_trim(r), on_trimmed)
    return let(raw, on_raw)


# ---------------------------------------------------------------- parse

def _lines(trace: Column) -> Column:
    """Lines as Java's split drops them: trailing empty lines removed. Text
    without a carriage return takes the plain path (char trim, one-char
    split, no regex)."""
    def lf_only(t):
        return let(F.rtrim(t, F.lit("\n")), lambda s: F.when(F.length(s) > 0, F.split(s, "\n", -1)))

    def with_cr(t):
        return let(F.regexp_replace(t, TRAILING_NEWLINES_RE, ""),
                   lambda s: F.when(F.length(s) > 0, F.split(s, LINE_SPLIT_RE, -1)))

    return let(trace, lambda t: F.when(F.contains(t, F.lit("\r")), with_cr(t)).otherwise(lf_only(t)))


def _classified(lines: Column) -> Column:
    """Lines after the first, as struct<line, kind>; kind C, M, F or X.
    The three line shapes exclude each other, so frames (the common case)
    are tested first."""
    def kind(l):
        return (F.when(l.rlike(RAW_FRAME_RE), F.lit("F"))
                .when(l.rlike(CAUSE_RE), F.lit("C"))
                .when(l.rlike(MORE_RE), F.lit("M"))
                .otherwise(F.lit("X")))

    return F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
                       lambda l: F.struct(l.alias("line"), kind(l).alias("kind")))


def _kept(items: Column) -> Column:
    """Items before the first line of kind X."""
    def cut(xs):
        stop = F.array_position(F.transform(xs, lambda x: x["kind"] == "X"), True)
        return F.slice(xs, 1, F.when(stop == 0, F.size(xs)).otherwise(stop - 1).cast("int"))
    return let(items, cut)


def _frames_of(items: Column) -> Column:
    frames = F.filter(items, lambda x: x["kind"] == "F")
    return F.transform(frames, lambda x: _frame_struct(x["line"], F.lit(True)))


def _outer_items(kept: Column) -> Column:
    def cut(xs):
        first_cause = F.array_position(F.transform(xs, lambda x: x["kind"] == "C"), True)
        n = F.when(first_cause == 0, F.size(xs)).otherwise(first_cause - 1).cast("int")
        return F.slice(xs, 1, n)
    return let(kept, cut)


def outer_frames(trace) -> Column:
    """Frames of the outermost exception only (null when no parse)."""
    return let(_lines(as_col(trace)),
               lambda ls: F.when(ls.isNotNull(), _frames_of(_outer_items(_kept(_classified(ls))))))


def parse_trace(trace) -> Column:
    """``struct<exception_class, exception_message, frames, causes>``.

    Null for a null, empty or newline-only trace. ``causes`` is
    ``array<struct<depth, exception_class, exception_message, frames>>``
    with depth 1 for the direct cause.
    """
    def on_lines(ls):
        def on_kept(kept):
            n = F.size(kept)
            cause_pos = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                 lambda i: (i <= n) & (F.try_element_at(kept, i)["kind"] == "C"))

            def on_pos(pos):
                def cause(p, j):
                    nxt = F.coalesce(F.try_element_at(pos, j + 2), n + 1)
                    head = _exception_head(F.regexp_extract(F.element_at(kept, p)["line"], CAUSE_RE, 1))
                    body = F.slice(kept, p + 1, (nxt - p - 1).cast("int"))
                    return F.struct((j + 1).cast("int").alias("depth"),
                                    head["cls"].alias("exception_class"),
                                    head["msg"].alias("exception_message"),
                                    _frames_of(body).alias("frames"))
                return F.when(F.size(pos) > 0, F.transform(pos, cause)).otherwise(
                    F.array().cast(_CAUSES_TYPE))

            head = _exception_head(java_trim(F.element_at(ls, 1)))
            return F.struct(head["cls"].alias("exception_class"),
                            head["msg"].alias("exception_message"),
                            _frames_of(_outer_items(kept)).alias("frames"),
                            let(cause_pos, on_pos).alias("causes"))
        return F.when(ls.isNotNull(), let(_kept(_classified(ls)), on_kept))
    return let(_lines(as_col(trace)), on_lines)


_CAUSES_TYPE = ("array<struct<depth:int,exception_class:string,exception_message:string,"
                "frames:array<struct<class_name:string,method_name:string,file_name:string,"
                "line_number:int,native:boolean>>>>")


def user_frames(frames, mode: str = "core") -> Column:
    """frames that are not framework code."""
    return F.filter(as_col(frames), lambda f: ~is_framework(f["class_name"], mode))


def top_user_frames(frames, n: int = 5, mode: str = "core") -> Column:
    return F.slice(user_frames(frames, mode), 1, n)


def top_frame(frames) -> Column:
    return F.try_element_at(as_col(frames), F.lit(1))


def first_user_frame(frames, mode: str = "core") -> Column:
    return F.try_element_at(user_frames(frames, mode), F.lit(1))


def has_user_frames(frames, mode: str = "core") -> Column:
    return F.exists(as_col(frames), lambda f: ~is_framework(f["class_name"], mode))


def root_cause(parsed) -> Column:
    """deepest cause, or the trace itself when it has no cause."""
    p = as_col(parsed)
    last = F.try_element_at(p["causes"], F.lit(-1))
    return F.when(p.isNull(), F.lit(None)).when(
        F.size(p["causes"]) > 0,
        F.struct(last["exception_class"].alias("exception_class"),
                 last["exception_message"].alias("exception_message"),
                 last["frames"].alias("frames"))).otherwise(
        F.struct(p["exception_class"].alias("exception_class"),
                 p["exception_message"].alias("exception_message"),
                 p["frames"].alias("frames")))


# ---------------------------------------------------------------- F4

def exception_head_line(trace, mode: str = "core") -> Column:
    """The text F4 reads the class from; null when there is no trace.

    core: the text before the first newline when that newline is not at
    index 0, else the whole text. cloud: the text before the first newline.
    """
    t = as_col(trace)
    present = t.isNotNull() & (F.length(t) > 0)
    if mode == "core":
        nl = F.instr(t, "\n")
        return F.when(present, F.when(nl > 1, F.substring_index(t, "\n", 1)).otherwise(t))
    return F.when(present, F.substring_index(t, "\n", 1))


def class_of_head_line(head, mode: str = "core") -> Column:
    """F4 on the output of :func:`exception_head_line`."""
    h = as_col(head)
    if mode == "core":
        return F.when(h.isNotNull(), _exception_class_only(java_trim(h)))
    return F.when(h.isNotNull(),
                  F.when(h.rlike(CLOUD_EXCEPTION_RE), F.regexp_extract(h, CLOUD_EXCEPTION_RE, 1))
                  .otherwise(js_trim(F.substring_index(h, ":", 1))))


def exception_class(trace, mode: str = "core") -> Column:
    """exception class from the first line of a trace text.

    core: trimmed first line; the full exception pattern, else the text
    before a colon at index > 0, else the whole line. cloud: a class-like
    prefix ending in Exception/Error/Throwable (no end anchor), else the
    text before the first colon, trimmed.
    """
    return class_of_head_line(exception_head_line(trace, mode), mode)


# Beyond ASCII, ECMAScript white space adds these; a trace without any of
# them can use the same patterns with the short ASCII class (much faster).
_JS_EXTRA_SPACE = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_ASCII_FRAME_RE = r"at[\t\n\x0B\f\r ]+([^\t\n\x0B\f\r ]+)\(([^)]+)\)"


def _cloud_frames_with(lines: Column, frame_re: str, n: int) -> Column:
    # the first frame of a line rewritten to "name\x01location" in one pass;
    # the lazy prefix makes it the leftmost match, as a search finds it
    first_re = r"\A[\s\S]*?" + frame_re + r"[\s\S]*\z"
    found = F.filter(lines, lambda l: F.contains(l, F.lit("at")) & F.contains(l, F.lit("("))
                     & l.rlike(frame_re))
    named = F.transform(found, lambda l: F.split(F.regexp_replace(l, first_re, "$1\u0001$2"), "\u0001", 2))
    user = F.filter(named, lambda x: ~x[0].rlike(framework_regex("cloud")))
    return F.slice(F.transform(user, lambda x: F.concat(x[0], F.lit(":"), x[1])), 1, n)


def cloud_frames(trace, n: int = 5) -> Column:
    """cloud: first ``n`` non-framework ``name:location`` texts of a trace,
    any line, causes included (the first frame of each line). Lines that
    cannot hold a frame (no ``at`` or no ``(``) skip the regex."""
    t = as_col(trace)
    lines = F.split(t, "\n", -1)
    return F.when(t.rlike(_JS_EXTRA_SPACE), _cloud_frames_with(lines, CLOUD_FRAME_RE, n)).otherwise(
        _cloud_frames_with(lines, _ASCII_FRAME_RE, n))


# ---------------------------------------------------------------- F12-F14, F16

def simple_class_name(class_name) -> Column:
    """text after the last dot (whole name if none)."""
    return F.substring_index(as_col(class_name), ".", -1)


def package_name(class_name) -> Column:
    """text before the last dot, or empty when there is no dot."""
    c = as_col(class_name)
    return F.when(F.instr(c, ".") > 0, F.regexp_extract(c, r"\A([\s\S]*)\.", 1)).otherwise(
        F.when(c.isNotNull(), F.lit("")))


def has_source_info(frame) -> Column:
    """frame has a file and a positive line."""
    f = as_col(frame)
    return f["file_name"].isNotNull() & (f["line_number"] > 0)


def format_frame(frame) -> Column:
    """a frame back to text, ``cls.method(File.java:n)``."""
    f = as_col(frame)
    where = (F.when(f["native"], F.lit("(Native Method)"))
             .when(f["file_name"].isNotNull() & (f["line_number"] >= 0),
                   F.concat(F.lit("("), f["file_name"], F.lit(":"),
                            f["line_number"].cast("string"), F.lit(")")))
             .when(f["file_name"].isNotNull(), F.concat(F.lit("("), f["file_name"], F.lit(")")))
             .otherwise(F.lit("(Unknown Source)")))
    return F.concat(F.coalesce(f["class_name"], F.lit("null")), F.lit("."),
                    F.coalesce(f["method_name"], F.lit("null")), where)


def _format_one(cls: Column, msg: Column, frames: Column) -> Column:
    head = F.concat(F.coalesce(cls, F.lit("null")),
                    F.coalesce(F.concat(F.lit(": "), msg), F.lit("")), F.lit("\n"))
    body = F.array_join(F.transform(frames, lambda f: F.concat(F.lit("\tat "), format_frame(f),
                                                               F.lit("\n"))), "")
    return F.concat(head, body)


def format_trace(parsed) -> Column:
    """a parsed trace back to text, with its cause chain."""
    p = as_col(parsed)
    causes = F.array_join(F.transform(p["causes"], lambda c: F.concat(
        F.lit("Caused by: "), _format_one(c["exception_class"], c["exception_message"],
                                         c["frames"]))), "")
    return F.when(p.isNotNull(), F.concat(
        _format_one(p["exception_class"], p["exception_message"], p["frames"]), causes))


def trace_preview(trace, n: int = 10) -> Column:
    """F16: ``struct<lines, more>``: first n lines (split on newline,
    trailing empty lines dropped) and how many lines are left."""
    t = as_col(trace)
    stripped = F.regexp_replace(t, r"\n+\z", "")
    lines = F.when(F.length(stripped) > 0, F.split(stripped, "\n", -1)).otherwise(
        F.array().cast("array<string>"))
    return F.when(t.isNotNull(), F.struct(
        F.slice(lines, 1, n).alias("lines"),
        F.greatest(F.size(lines) - n, F.lit(0)).alias("more")))
