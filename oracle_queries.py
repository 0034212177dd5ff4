"""DuckDB oracle SQL for the registered queries.

Independent formulations of the same rules in DuckDB SQL (RE2 regex, list
lambdas), used only to check the Spark operators. Builders return SQL
expression text over column names.
"""

from __future__ import annotations

from errorlens.sources.fixtures import log_view_sql

LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
# Class-name prefixes of framework code.
CORE_PREFIXES = ["java.", "javax.", "sun.", "com.sun.", "jdk.", "org.springframework.",
                 "org.apache.", "org.hibernate.", "org.slf4j.", "ch.qos.logback.",
                 "com.zaxxer.hikari.", "io.netty.", "reactor.", "com.fasterxml.jackson."]
CLOUD_PREFIXES = CORE_PREFIXES[:10]
JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def jtrim(e: str) -> str:
    return f"regexp_replace({e}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def jstrim(e: str) -> str:
    return f"regexp_replace({e}, '^[{JS_SPACE}]+|[{JS_SPACE}]+$', '', 'g')"


def level(e: str = "level") -> str:
    names = ", ".join(q(x) for x in LEVELS)
    return (f"(CASE WHEN upper({e}) IN ({names}) THEN upper({e}) WHEN upper({e}) = 'WARNING' "
            f"THEN 'WARN' WHEN upper({e}) = 'SEVERE' THEN 'ERROR' ELSE 'INFO' END)")


def level_rank(e: str) -> str:
    whens = " ".join(f"WHEN {e} = {q(x)} THEN {i}" for i, x in enumerate(LEVELS))
    return f"(CASE {whens} END)"


# Its patterns and tokens are fixed values.
def normalize(e: str, mode: str = "core") -> str:
    uuid = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    rules = [
        (("(?i)" if mode == "cloud" else "") + uuid, "<UUID>"),
        (r"\b\d{6,}\b", "<ID>"),
        (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
        (r"[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}", "<EMAIL>"),
        (r'"[^"]+"', '"<STRING>"'),
        (r"'[^']+'", "'<STRING>'"),
    ]
    if mode == "core":
        rules.append((r"\b\d+\b", "<NUM>"))
    out = e
    for pat, rep in rules:
        out = f"regexp_replace({out}, {q(pat)}, {q(rep)}, 'g')"
    out = jtrim(out) if mode == "core" else jstrim(out)
    return f"coalesce({out}, '')"


# Line grammar of a Java stack trace.
EXC = r"([\w.$]+(?:Exception|Error|Throwable))(?::\s*(.*))?"
EXC_BARE = r"[\w.$]+(?:Exception|Error|Throwable)"
FRAME = r"\s*at\s+([\w.$]+)\.([\w$<>]+)\(([^)]+)\)"
LOC = r"(\w+\.java):(\d+)"
CAUSE = r"Caused by:\s*(.+)"
MORE = r"\s*\.\.\.\s*(\d+)\s+more\s*"


def head_class(raw: str) -> str:
    """Class of an exception line: full pattern on the trimmed text, else
    the text before a colon at index > 0, else the trimmed text."""
    t = jtrim(raw)
    return (f"(CASE WHEN regexp_full_match({t}, {q(EXC)}) THEN regexp_extract({t}, {q(EXC)}, 1) "
            f"WHEN strpos({raw}, ':') > 1 THEN {jtrim(f'substr({raw}, 1, strpos({raw}, chr(58)) - 1)')} "
            f"ELSE {t} END)")


def head_message(raw: str) -> str:
    t = jtrim(raw)
    return (f"(CASE WHEN regexp_full_match({t}, {q(EXC)}) THEN "
            f"(CASE WHEN regexp_full_match({t}, {q(EXC_BARE)}) THEN NULL ELSE regexp_extract({t}, {q(EXC)}, 2) END) "
            f"WHEN strpos({raw}, ':') > 1 THEN {jtrim(f'substr({raw}, strpos({raw}, chr(58)) + 1)')} "
            f"ELSE NULL END)")


def lines(e: str) -> str:
    s = f"regexp_replace({e}, '(\\r?\\n)+$', '')"
    return f"(CASE WHEN length({s}) > 0 THEN string_split_regex({s}, '\\r?\\n') END)"


def kind(l: str) -> str:
    return (f"(CASE WHEN regexp_full_match({l}, {q(CAUSE)}) THEN 'C' "
            f"WHEN regexp_full_match({l}, {q(MORE)}) THEN 'M' "
            f"WHEN regexp_full_match({jtrim(l)}, {q(FRAME)}) THEN 'F' ELSE 'X' END)")


def frame_line(t: str) -> str:
    """Line number of a trimmed frame line."""
    loc = f"regexp_extract({t}, {q(FRAME)}, 3)"
    return (f"(CASE WHEN {loc} IN ('Native Method', 'Unknown Source') THEN -1 "
            f"WHEN regexp_full_match({loc}, {q(LOC)}) THEN CAST(regexp_extract({loc}, {q(LOC)}, 2) AS INTEGER) "
            f"ELSE -1 END)")


def framework(cls: str, prefixes) -> str:
    pat = "^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"
    return f"regexp_matches({cls}, {q(pat)})"


def trace_key(trace: str, frames: int = 5) -> str:
    """core fingerprint of a trace; NULL when it does not parse."""
    ls = lines(trace)
    tail = f"list_slice({ls}, 2, len({ls}))"
    kinds = f"list_transform({tail}, lambda l: {kind('l')})"
    stop = f"coalesce(list_position({kinds}, 'X') - 1, len({kinds}))"
    kept_kinds = f"list_slice({kinds}, 1, {stop})"
    outer_n = f"coalesce(list_position({kept_kinds}, 'C') - 1, {stop})"
    outer = f"list_slice({tail}, 1, {outer_n})"
    outer_kinds = f"list_slice({kinds}, 1, {outer_n})"
    frame_lines = f"list_transform(list_filter({outer}, lambda l, i: {outer_kinds}[i] = 'F'), lambda l: {jtrim('l')})"
    keys = (f"list_transform({frame_lines}, lambda t: regexp_extract(t, {q(FRAME)}, 1) || '.' || "
            f"regexp_extract(t, {q(FRAME)}, 2) || ':' || CAST({frame_line('t')} AS VARCHAR))")
    user = f"list_filter({keys}, lambda k: NOT {framework('k', CORE_PREFIXES)})"
    top = f"list_slice({user}, 1, {frames})"
    cls = head_class(f"{ls}[1]")
    return (f"(CASE WHEN {ls} IS NOT NULL THEN coalesce({cls}, 'Unknown') || "
            f"array_to_string(list_transform({top}, lambda k: '|' || k), '') END)")


def cloud_frames(trace: str, frames: int = 5) -> str:
    pat = f"at[{JS_SPACE}]+([^{JS_SPACE}]+)\\(([^)]+)\\)"
    found = f"list_filter(string_split({trace}, chr(10)), lambda l: regexp_matches(l, {q(pat)}))"
    named = (f"list_transform({found}, lambda l: {{'name': regexp_extract(l, {q(pat)}, 1), "
             f"'loc': regexp_extract(l, {q(pat)}, 2)}})")
    user = f"list_filter({named}, lambda x: NOT {framework('x.name', CLOUD_PREFIXES)})"
    return f"list_slice(list_transform({user}, lambda x: x.name || ':' || x.loc), 1, {frames})"


def location_key(c="class_name", m="method_name", l="line_number") -> str:
    return (f"(coalesce({c}, '') || coalesce('.' || {m}, '') || "
            f"coalesce(':' || CAST({l} AS VARCHAR), ''))")


def has_trace(t: str = "stack_trace") -> str:
    return f"({t} IS NOT NULL AND length({t}) > 0)"


def fingerprint(mode: str = "core", frames: int = 5) -> str:
    if mode == "core":
        tk = trace_key("stack_trace", frames)
        loc = location_key()
        return (f"(CASE WHEN {has_trace()} AND {tk} IS NOT NULL THEN {tk} "
                f"WHEN {loc} <> '' THEN {loc} ELSE {normalize('message', 'core')} END)")
    cf = cloud_frames("stack_trace", frames)
    parts = ("concat_ws('|', CASE WHEN length(class_name) > 0 THEN class_name END, "
             "CASE WHEN length(method_name) > 0 THEN method_name END, "
             "CASE WHEN line_number <> 0 THEN CAST(line_number AS VARCHAR) END)")
    msg = "(CASE WHEN message IS NULL OR length(message) = 0 THEN 'unknown' ELSE message END)"
    return (f"(CASE WHEN {has_trace()} AND len({cf}) > 0 THEN array_to_string({cf}, '|') "
            f"WHEN {parts} <> '' THEN {parts} ELSE {normalize(msg, 'cloud')} END)")


def head_line(mode: str, t: str = "stack_trace") -> str:
    if mode == "core":
        return (f"(CASE WHEN {has_trace(t)} THEN (CASE WHEN strpos({t}, chr(10)) > 1 "
                f"THEN substr({t}, 1, strpos({t}, chr(10)) - 1) ELSE {t} END) END)")
    return f"(CASE WHEN {has_trace(t)} THEN split_part({t}, chr(10), 1) END)"


def class_of_head(h: str, mode: str) -> str:
    if mode == "core":
        return f"(CASE WHEN {h} IS NOT NULL THEN {head_class(jtrim(h))} END)"
    pat = r"^([A-Za-z0-9_.]+(?:Exception|Error|Throwable))"
    return (f"(CASE WHEN {h} IS NULL THEN NULL WHEN regexp_matches({h}, {q(pat)}) "
            f"THEN regexp_extract({h}, {q(pat)}, 1) ELSE {jstrim(f'split_part({h}, chr(58), 1)')} END)")


def cluster_id(fp: str) -> str:
    h = (f"list_reduce(list_transform(string_split({fp}, ''), lambda c: CAST(unicode(c) AS BIGINT)), "
         f"lambda a, x: (a * 31 + x) % 4294967296, CAST(0 AS BIGINT))")
    return f"printf('ERR-%08X', CASE WHEN length({fp}) = 0 THEN 0 ELSE {h} END)"


def severity(c: str) -> str:
    return (f"(CASE WHEN {c} >= 100 THEN 'CRITICAL' WHEN {c} >= 50 THEN 'HIGH' "
            f"WHEN {c} >= 10 THEN 'MEDIUM' ELSE 'LOW' END)")


# ---------------------------------------------------------------- tables

def logs_cte() -> str:
    """CTE ``logs``: the derived log view with canonical levels."""
    view = log_view_sql("events")
    return (f"raw_logs AS ({view}),\n"
            f"logs AS (SELECT * REPLACE ({level('level')} AS level) FROM raw_logs)")


def clusters_cte(mode: str = "core", by: tuple[str, ...] = (), src: str = "logs",
                 name: str = "clusters") -> str:
    """CTE ``name`` (plus helpers ``name_rows``, ``name_agg``) over ``src``."""
    keys = "".join(f"{k}, " for k in by)
    order = "row(timestamp, id)"
    if mode == "core":
        head = f"arg_max_null(_head, {order}) FILTER (WHERE _head IS NOT NULL)"
        loc = f"arg_max_null(_loc, {order}) FILTER (WHERE file_name IS NOT NULL)"
    else:
        head = f"arg_max_null(_head, {order})"
        loc = f"arg_max_null(_loc, {order})"
    return f"""{name}_rows AS (
  SELECT {keys}{fingerprint(mode)} AS fingerprint, timestamp, id, message,
         {head_line(mode)} AS _head, file_name,
         {{'file_name': file_name, 'line_number': line_number, 'method_name': method_name, 'class_name': class_name}} AS _loc
  FROM {src} WHERE level IN ('ERROR', 'FATAL')),
{name}_agg AS (
  SELECT {keys}fingerprint, count(*) AS occurrence_count, min(timestamp) AS first_seen,
         max(timestamp) AS last_seen, arg_max_null(message, {order}) AS _message,
         {head} AS _head, {loc} AS _loc
  FROM {name}_rows GROUP BY {keys}fingerprint),
{name} AS (
  SELECT {keys}{cluster_id('fingerprint')} AS cluster_id, fingerprint,
         {class_of_head('_head', mode)} AS exception_class,
         {normalize('_message', mode)} AS message_pattern,
         _loc.file_name AS primary_file, _loc.line_number AS primary_line,
         _loc.method_name AS primary_method, _loc.class_name AS primary_class,
         first_seen, last_seen, occurrence_count, {severity('occurrence_count')} AS severity
  FROM {name}_agg)"""


def with_logs(*ctes: str) -> str:
    """``WITH raw_logs, logs, ...`` header."""
    return "WITH " + ",\n".join([logs_cte(), *ctes]) + "\n"


def apps_cte() -> str:
    from errorlens.sources.fixtures import APPLICATIONS_SQL, duck_sql
    return f"apps AS ({duck_sql(APPLICATIONS_SQL)})"


def state_ctes() -> list[str]:
    """CTEs ``state`` (stored clusters) and ``analyses``."""
    from errorlens.sources.fixtures import ANALYSES_SQL, CLUSTER_STATE_SQL, STATE_CUT, duck_sql
    return [
        f"before_cut AS (SELECT * FROM logs WHERE timestamp < TIMESTAMP '{STATE_CUT}')",
        clusters_cte("cloud", ("app_id",), src="before_cut", name="old_clusters"),
        f"state AS ({duck_sql(CLUSTER_STATE_SQL, clusters='old_clusters')})",
        f"analyses AS ({duck_sql(ANALYSES_SQL, state='state')})",
    ]


def format_count(c: str) -> str:
    def scaled(unit, suffix):
        t = f"(({c}) * 10 + {unit // 2}) // {unit}"
        return f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '{suffix}'"
    return (f"(CASE WHEN ({c}) >= 1000000 THEN {scaled(1000000, 'M')} WHEN ({c}) >= 1000 "
            f"THEN {scaled(1000, 'K')} ELSE CAST(({c}) AS VARCHAR) END)")


def mdc_pairs(m: str) -> str:
    """Valid ``k=v`` pairs of a context text, as structs, in order."""
    return (f"list_transform(list_filter(string_split({m}, ';'), lambda p: strpos(p, '=') > 1), "
            f"lambda p: {{'key': substr(p, 1, strpos(p, '=') - 1), 'value': substr(p, strpos(p, '=') + 1)}})")


def mdc_value(m: str, key: str) -> str:
    """Value of the last pair with ``key``."""
    hits = f"list_filter({mdc_pairs(m)}, lambda e: e.key = {q(key)})"
    return f"(CASE WHEN len({hits}) > 0 THEN {hits}[-1].value END)"


# ---------------------------------------------------------------- traces

def kept_kinds(trace: str) -> tuple[str, str]:
    """(tail lines, kinds of the kept tail lines) expressions of a trace."""
    ls = lines(trace)
    tail = f"list_slice({ls}, 2, len({ls}))"
    kinds = f"list_transform({tail}, lambda l: {kind('l')})"
    stop = f"coalesce(list_position({kinds}, 'X') - 1, len({kinds}))"
    return f"list_slice({tail}, 1, {stop})", f"list_slice({kinds}, 1, {stop})"


def outer_frame_lines(trace: str) -> str:
    tail, kk = kept_kinds(trace)
    n = f"coalesce(list_position({kk}, 'C') - 1, len({kk}))"
    return (f"list_transform(list_filter(list_slice({tail}, 1, {n}), lambda l, i: {kk}[i] = 'F'), "
            f"lambda l: {jtrim('l')})")


def frame_file(t: str) -> str:
    loc = f"regexp_extract({t}, {q(FRAME)}, 3)"
    return (f"(CASE WHEN {loc} IN ('Native Method', 'Unknown Source') THEN NULL "
            f"WHEN regexp_full_match({loc}, {q(LOC)}) THEN regexp_extract({loc}, {q(LOC)}, 1) ELSE {loc} END)")


# ---------------------------------------------------------------- responses

# Section markers of an answer.
MARKERS = ["EXPLANATION", "ROOT_CAUSE", "RECOMMENDATION", "PATCH"]


def section_re(name: str, mode: str) -> str:
    others = "|".join(f"{m}:" for m in MARKERS if m != name)
    if mode == "core":
        return rf"(?is){name}:\s*(.+?)(?:{others}|$)"
    return rf"(?s){name}:[{JS_SPACE}]*(.+?)(?:{others}|$)"


def patch_re(mode: str) -> str:
    if mode == "core":
        return r"(?is)PATCH:\s*```(?:diff)?\s*(.+?)```"
    return rf"(?s)PATCH:[{JS_SPACE}]*```(?:diff)?[{JS_SPACE}]*(.+?)```"


def section(t: str, name: str, mode: str) -> str:
    pat = section_re(name, mode)
    raw = f"(CASE WHEN regexp_matches({t}, {q(pat)}) THEN regexp_extract({t}, {q(pat)}, 1) END)"
    if mode == "core":
        return jtrim(raw)
    return f"nullif({jstrim(raw)}, '')"


def response_patch(t: str, mode: str) -> str:
    pat = patch_re(mode)
    raw = f"(CASE WHEN regexp_matches({t}, {q(pat)}) THEN regexp_extract({t}, {q(pat)}, 1) END)"
    if mode == "core":
        p = jtrim(raw)
        return (f"(CASE WHEN strpos(lower({p}), 'no code changes needed') = 0 AND "
                f"strpos(lower({p}), 'not applicable') = 0 THEN {p} END)")
    return f"nullif({jstrim(raw)}, '')"


def confidence(t: str, mode: str) -> str:
    if mode == "core":
        pts = [f"(strpos({t}, '{m}:') > 0)" for m in MARKERS] + [
            f"(length({t}) > 500)", f"(length({t}) > 1000)", f"(strpos({t}, '```') > 0)"]
        s = " + ".join(f"CAST({p} AS INTEGER)" for p in pts)
        return (f"(CASE WHEN {t} IS NULL OR length({t}) = 0 THEN 'UNKNOWN' WHEN {s} >= 6 THEN 'HIGH' "
                f"WHEN {s} >= 4 THEN 'MEDIUM' WHEN {s} >= 2 THEN 'LOW' ELSE 'UNKNOWN' END)")
    pts = [f"regexp_matches({t}, {q(section_re(m, 'cloud'))})" for m in MARKERS[:3]]
    pts += [f"regexp_matches({t}, {q(patch_re('cloud'))})", f"(length({t}) > 500)", f"(length({t}) > 1000)"]
    s = " + ".join(f"CAST(coalesce({p}, false) AS INTEGER)" for p in pts)
    return (f"(CASE WHEN {s} >= 5 THEN 'HIGH' WHEN {s} >= 3 THEN 'MEDIUM' WHEN {s} >= 1 THEN 'LOW' "
            f"ELSE 'UNKNOWN' END)")


def valid_diff(p: str) -> str:
    return (f"coalesce(length({p}) >= 20 AND strpos({p}, '---') > 0 AND strpos({p}, '+++') > 0 AND "
            f"strpos({p}, '@@') > 0 AND (strpos({p}, chr(10) || '+') > 0 OR strpos({p}, chr(10) || '-') > 0), false)")


def format_patch(p: str) -> str:
    lf = f"replace({p}, chr(13) || chr(10), chr(10))"
    return f"(CASE WHEN {lf} LIKE '%' || chr(10) THEN {lf} ELSE {lf} || chr(10) END)"


def extract_patch(t: str, mode: str) -> str:
    if mode == "core":
        pat = r"(?s)```(?:diff)?\s*(.+?)```"
        b = jtrim(f"(CASE WHEN regexp_matches({t}, {q(pat)}) THEN regexp_extract({t}, {q(pat)}, 1) END)")
        return (f"(CASE WHEN strpos(lower({b}), 'no code changes') = 0 AND strpos(lower({b}), 'not applicable') = 0 "
                f"AND length({b}) > 10 THEN {b} END)")
    bpat = f"```(?:diff)?[{JS_SPACE}]*([\\s\\S]*?)```"
    dpat = r"((?:---[\s\S]*?\+\+\+[\s\S]*?@@[\s\S]+))"
    block = jstrim(f"(CASE WHEN regexp_matches({t}, {q(bpat)}) THEN regexp_extract({t}, {q(bpat)}, 1) END)")
    bare = jstrim(f"(CASE WHEN regexp_matches({t}, {q(dpat)}) THEN regexp_extract({t}, {q(dpat)}, 1) END)")
    whole = f"(CASE WHEN strpos({t}, '---') > 0 AND strpos({t}, '+++') > 0 AND strpos({t}, '@@') > 0 THEN {jstrim(t)} END)"
    pick = f"(CASE WHEN {valid_diff(block)} THEN {block} WHEN {valid_diff(bare)} THEN {bare} ELSE {whole} END)"
    return f"(CASE WHEN {pick} IS NOT NULL THEN {format_patch(pick)} END)"


def patch_target(p: str) -> str:
    line = f"regexp_extract({p}, '(?m)^(\\+\\+\\+ .*)$', 1)"
    path = f"substr({line}, strpos({line}, ' ') + 1)"
    path = f"(CASE WHEN starts_with({path}, 'b/') THEN substr({path}, 3) ELSE {path} END)"
    return f"(CASE WHEN length({line}) > 0 THEN {jtrim(path)} END)"


# ---------------------------------------------------------------- code context

METHOD_RE = (r"^\s*(public|private|protected|static|final|abstract|synchronized|native|\s)*"
             r"\s*(<[^>]+>\s*)?\s*(\w+(?:<[^>]+>)?(?:\[\])?)\s+(\w+)\s*\(")
CLASS_RE = r"^\s*(public|private|protected|static|final|abstract|\s)*\s*(class|interface|enum|record)\s+(\w+)"
IMPORT_RE = r"\s*import\s+(static\s+)?([\w.]+(?:\.\*)?);\s*"
FIELD_RE = (r"^\s*(public|private|protected|static|final|volatile|transient|\s)*"
            r"\s*(\w+(?:<[^>]+>)?(?:\[\])?)\s+(\w+)\s*[;=]")


def code_context_sql(clusters: str, sources: str, n: int = 10, plain: bool = False) -> str:
    """One row per cluster with its code context, as a full statement
    (``plain`` adds the surrounding lines joined by newlines)."""
    fl = "l.root_rank = t.root_rank AND l.rel_path = t.rel_path"
    return f"""WITH
cl AS (SELECT fingerprint, primary_class, primary_line AS L FROM {clusters}
       WHERE primary_class IS NOT NULL AND length(primary_class) > 0),
found AS (SELECT c.fingerprint, c.L, min(s.root_rank) AS root_rank, s.rel_path FROM cl c JOIN {sources} s
          ON s.rel_path = replace(split_part(c.primary_class, '$', 1), '.', '/') || '.java'
          GROUP BY c.fingerprint, c.L, s.rel_path),
used AS (SELECT s.* FROM {sources} s JOIN (SELECT DISTINCT root_rank, rel_path FROM found) f
         ON s.root_rank = f.root_rank AND s.rel_path = f.rel_path),
raw_lines AS (SELECT root_rank, rel_path, unnest(ls) AS text, generate_subscripts(ls, 1) AS n FROM (
  SELECT root_rank, rel_path, CASE WHEN length(content) > 0 THEN string_split_regex(
    regexp_replace(content, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') ELSE []::VARCHAR[] END AS ls FROM used)),
lines AS (SELECT *, sum(closes - opens) OVER w AS p, sum(opens) OVER w AS o FROM (
  SELECT root_rank, rel_path, n, text,
         length(text) - length(replace(text, '{{', '')) AS opens,
         length(text) - length(replace(text, '}}', '')) AS closes,
         regexp_matches(text, {q(CLASS_RE)}) AS is_class,
         CASE WHEN regexp_matches(text, {q(CLASS_RE)}) THEN regexp_extract(text, {q(CLASS_RE)}, 3) END AS class_name,
         regexp_matches(text, {q(METHOD_RE)}) AS is_method,
         regexp_full_match(text, {q(IMPORT_RE)}) AS is_import,
         regexp_matches(text, {q(FIELD_RE)}) AS is_field FROM raw_lines)
  WINDOW w AS (PARTITION BY root_rank, rel_path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sizes AS (SELECT root_rank, rel_path, max(n) AS size FROM lines GROUP BY ALL),
t AS (SELECT f.fingerprint, f.L, f.root_rank, f.rel_path, z.size, l.p AS pL FROM found f
      JOIN sizes z ON z.root_rank = f.root_rank AND z.rel_path = f.rel_path
      JOIN lines l ON l.root_rank = f.root_rank AND l.rel_path = f.rel_path AND l.n = f.L
      WHERE f.L >= 1 AND f.L <= z.size),
cls AS (SELECT t.fingerprint, arg_max(l.class_name, l.n) AS enclosing_class FROM t JOIN lines l ON {fl}
        WHERE l.is_class AND l.n <= t.L GROUP BY t.fingerprint),
ms AS (SELECT t.fingerprint, arg_max({{'s': l.n, 'pb': l.p - l.closes + l.opens, 'ob': l.o - l.opens,
              'text': l.text}}, l.n) AS m FROM t JOIN lines l ON {fl}
       WHERE l.is_method AND l.n <= t.L AND l.p - l.closes + l.opens >= t.pL GROUP BY t.fingerprint),
me AS (SELECT ms.fingerprint, min(l.n) AS e FROM ms JOIN t ON t.fingerprint = ms.fingerprint JOIN lines l ON {fl}
       WHERE l.p = ms.m.pb AND l.n >= ms.m.s AND l.o > ms.m.ob GROUP BY ms.fingerprint),
method AS (SELECT ms.fingerprint, regexp_extract(ms.m.text, {q(METHOD_RE)}, 4) AS method_name,
                  ms.m.s AS method_start, coalesce(me.e, t.size) AS method_end
           FROM ms JOIN t ON t.fingerprint = ms.fingerprint LEFT JOIN me ON me.fingerprint = ms.fingerprint),
body AS (SELECT m.fingerprint, string_agg(l.text || chr(10), '' ORDER BY l.n) AS method_body
         FROM method m JOIN t ON t.fingerprint = m.fingerprint JOIN lines l ON {fl}
         WHERE l.n BETWEEN m.method_start AND m.method_end GROUP BY m.fingerprint),
around AS (SELECT fingerprint, greatest(1, L - {n}) AS start_line, least(size, L + {n}) AS end_line FROM t),
ctx AS (SELECT a.fingerprint, count(*) AS n_lines, string_agg(CASE WHEN l.n = t.L THEN ' >>> ' ELSE '     ' END
          || printf('%4d | ', l.n) || l.text || chr(10), '' ORDER BY l.n) AS formatted_context,
          string_agg(l.text, chr(10) ORDER BY l.n) AS plain_context
        FROM around a JOIN t ON t.fingerprint = a.fingerprint JOIN lines l ON {fl}
        WHERE l.n BETWEEN a.start_line AND a.end_line GROUP BY a.fingerprint),
first_class AS (SELECT root_rank, rel_path, min(n) AS fc FROM lines WHERE is_class GROUP BY ALL),
imports AS (SELECT l.root_rank, l.rel_path, list({jtrim('l.text')} ORDER BY l.n) AS imports FROM lines l
            LEFT JOIN first_class f ON f.root_rank = l.root_rank AND f.rel_path = l.rel_path
            WHERE l.is_import AND (f.fc IS NULL OR l.n <= f.fc) GROUP BY ALL),
wanted AS (SELECT DISTINCT t.root_rank, t.rel_path, c.enclosing_class AS class_name FROM t
           JOIN cls c ON c.fingerprint = t.fingerprint),
fstart AS (SELECT l.root_rank, l.rel_path, l.class_name, arg_min({{'f': l.n, 'pf': l.p - l.closes + l.opens}}, l.n) AS x
           FROM lines l JOIN wanted w ON w.root_rank = l.root_rank AND w.rel_path = l.rel_path
           AND w.class_name = l.class_name WHERE l.is_class GROUP BY ALL),
fstop AS (SELECT fs.root_rank, fs.rel_path, fs.class_name, min(l.n) AS z FROM fstart fs JOIN lines l
          ON l.root_rank = fs.root_rank AND l.rel_path = fs.rel_path
          WHERE l.p = fs.x.pf AND l.n >= fs.x.f GROUP BY ALL),
fields AS (SELECT fs.root_rank, fs.rel_path, fs.class_name, list({jtrim('l.text')} ORDER BY l.n) AS class_fields
           FROM fstart fs LEFT JOIN fstop z ON z.root_rank = fs.root_rank AND z.rel_path = fs.rel_path
           AND z.class_name = fs.class_name JOIN lines l ON l.root_rank = fs.root_rank AND l.rel_path = fs.rel_path
           WHERE l.is_field AND l.n >= fs.x.f AND (z.z IS NULL OR l.n <= z.z) AND fs.x.pf - l.p = 1 GROUP BY ALL)
SELECT t.fingerprint, t.rel_path AS file_path, t.L AS target_line, c.enclosing_class AS class_name,
       m.method_name, m.method_start, m.method_end, a.start_line, a.end_line, x.n_lines,
       coalesce(i.imports, []::VARCHAR[]) AS imports, coalesce(fd.class_fields, []::VARCHAR[]) AS class_fields,
       b.method_body, x.formatted_context{", x.plain_context" if plain else ""}
FROM t LEFT JOIN cls c ON c.fingerprint = t.fingerprint LEFT JOIN method m ON m.fingerprint = t.fingerprint
LEFT JOIN body b ON b.fingerprint = t.fingerprint JOIN around a ON a.fingerprint = t.fingerprint
JOIN ctx x ON x.fingerprint = t.fingerprint
LEFT JOIN imports i ON i.root_rank = t.root_rank AND i.rel_path = t.rel_path
LEFT JOIN fields fd ON fd.root_rank = t.root_rank AND fd.rel_path = t.rel_path AND fd.class_name = c.enclosing_class"""


# ---------------------------------------------------------------- F14

def _fmt_frame_line(t: str) -> str:
    loc = f"regexp_extract({t}, {q(FRAME)}, 3)"
    f, ln = frame_file(t), frame_line(t)
    return (f"regexp_extract({t}, {q(FRAME)}, 1) || '.' || regexp_extract({t}, {q(FRAME)}, 2) || "
            f"(CASE WHEN {loc} = 'Native Method' THEN '(Native Method)' "
            f"WHEN {f} IS NOT NULL AND {ln} >= 0 THEN '(' || {f} || ':' || CAST({ln} AS VARCHAR) || ')' "
            f"WHEN {f} IS NOT NULL THEN '(' || {f} || ')' ELSE '(Unknown Source)' END)")


def _fmt_frames(lines_expr: str) -> str:
    return (f"array_to_string(list_transform({lines_expr}, lambda fl: chr(9) || 'at ' || "
            f"{_fmt_frame_line(jtrim('fl'))} || chr(10)), '')")


def _fmt_head(raw: str) -> str:
    return f"{head_class(raw)} || coalesce(': ' || {head_message(raw)}, '') || chr(10)"


def format_trace_sql(trace: str) -> str:
    """F14 of a parsed trace (NULL when it does not parse)."""
    ls = lines(trace)
    kt, kk = kept_kinds(trace)
    cpos = f"list_filter(generate_series(1, len({kk})), lambda ci: {kk}[ci] = 'C')"
    cause = (f"list_transform({cpos}, lambda cp, cj: 'Caused by: ' || "
             + _fmt_head(f"regexp_extract({kt}[cp], {q(CAUSE)}, 1)") + " || "
             + _fmt_frames(f"list_transform(list_filter(generate_series(cp + 1, coalesce({cpos}[cj + 1] - 1, "
                           f"len({kk}))), lambda fi: {kk}[fi] = 'F'), lambda fi: {kt}[fi])") + ")")
    outer = _fmt_head(jtrim(f"{ls}[1]")) + " || " + _fmt_frames(outer_frame_lines(trace))
    return f"(CASE WHEN {ls} IS NOT NULL THEN {outer} || array_to_string({cause}, '') END)"
