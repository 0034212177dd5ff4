"""Source code context of clusters.

Files are matched to clusters by equi-joins on a path key. Only matched
files are cut into lines (``posexplode``); per-file running sums of brace
balance (window per file, ordered by line) turn the reference's backward
and forward brace scans into comparisons of prefix sums, by which methods and
classes become intervals of lines. Lines that clusters point to meet them by
joins on file and depth; a field's lines are gathered by themselves:

* method start: the last method-looking line ``i <= L`` with
  ``P(i-1) >= P(L)``, where ``P`` is the running ``} - {`` count;
* method end: the first line ``j >= start`` that saw a ``{`` since the
  start and has ``P(j) == P(start-1)``, else the last line;
* class fields: lines at depth 1 from the first line declaring the class,
  up to the first line where the depth returns to 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from errorlens.functions._util import java_trim
from errorlens.session import checkpoint

# Line patterns of Java source.
METHOD_RE = (r"^\s*(public|private|protected|static|final|abstract|synchronized|native|\s)*"
             r"\s*(<[^>]+>\s*)?\s*(\w+(?:<[^>]+>)?(?:\[\])?)\s+(\w+)\s*\(")
CLASS_RE = r"^\s*(public|private|protected|static|final|abstract|\s)*\s*(class|interface|enum|record)\s+(\w+)"
IMPORT_RE = r"\A\s*import\s+(static\s+)?([\w.]+(?:\.\*)?);\s*\z"
FIELD_RE = (r"^\s*(public|private|protected|static|final|volatile|transient|\s)*"
            r"\s*(\w+(?:<[^>]+>)?(?:\[\])?)\s+(\w+)\s*[;=]")
LINE_BREAK_RE = r"\r\n|\r|\n"
CONTEXT_LINES = 10


# ---------------------------------------------------------------- S6

def read_sources(spark: SparkSession, roots: list[str], glob: str = "*.java") -> DataFrame:
    """Source files under ranked roots as ``(root_rank, rel_path,
    file_name, content)``; rank 0 is searched first."""
    out = None
    for rank, root in enumerate(roots):
        base = root.rstrip("/")
        df = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
              .text(base, wholetext=True)
              .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
        rel = F.regexp_replace(F.regexp_replace("path", r"^file:", ""), r"^.*?" + _quote(base) + "/", "")
        df = df.select(F.lit(rank).alias("root_rank"), rel.alias("rel_path"),
                       F.substring_index("path", "/", -1).alias("file_name"), "content")
        out = df if out is None else out.unionByName(df)
    return out


def _quote(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in text)


# ---------------------------------------------------------------- J9, J10

def class_source_path(class_name) -> F.Column:
    """Class name cut at the first ``$``, dots to slashes, plus ``.java``."""
    c = F.col(class_name) if isinstance(class_name, str) else class_name
    return F.concat(F.replace(F.substring_index(c, "$", 1), F.lit("."), F.lit("/")), F.lit(".java"))


def match_sources(clusters: DataFrame, sources: DataFrame, keys=("fingerprint",),
                  class_col: str = "primary_class") -> DataFrame:
    """Each cluster with the source file of its class from the first
    root that has it: ``keys + (root_rank, rel_path, content)``."""
    c = clusters.filter(F.col(class_col).isNotNull() & (F.length(class_col) > 0)).select(
        *keys, class_source_path(class_col).alias("rel_path"))
    j = c.join(sources.select("root_rank", "rel_path"), "rel_path")
    best = j.groupBy(*keys).agg(F.min_by(F.struct("root_rank", "rel_path"), "root_rank").alias("_s"))
    return best.select(*keys, F.col("_s.root_rank").alias("root_rank"), F.col("_s.rel_path").alias("rel_path"))


def match_sources_by_name(clusters: DataFrame, sources: DataFrame, keys=("fingerprint",),
                          file_col: str = "primary_file") -> DataFrame:
    """Each cluster with the first file of that base name, roots in
    rank order and, within a root, paths in text order."""
    c = clusters.filter(F.col(file_col).isNotNull() & (F.length(file_col) > 0)).select(
        *keys, F.col(file_col).alias("file_name"))
    j = c.join(sources.select("root_rank", "rel_path", "file_name"), "file_name")
    best = j.groupBy(*keys).agg(F.min(F.struct("root_rank", "rel_path")).alias("_s"))
    return best.select(*keys, F.col("_s.root_rank").alias("root_rank"), F.col("_s.rel_path").alias("rel_path"))


# ---------------------------------------------------------------- lines

def _count(line, ch: str) -> F.Column:
    return F.length(line) - F.length(F.replace(line, F.lit(ch), F.lit("")))


def file_lines(sources: DataFrame) -> DataFrame:
    """One row per line of each file: ``root_rank, rel_path, n, text``,
    line flags, the running brace sum ``p`` (``}`` minus ``{`` up to and
    including the line), ``enclosing`` (the last class named at or above the line),
    ``opened`` (the first line from here on with a ``{``), and of the file its
    ``size`` in lines and ``head``, its first class line. A final line break does not start another line."""
    body = F.regexp_replace("content", r"(\r\n|\r|\n)\z", "")
    lines = sources.select("root_rank", "rel_path", F.posexplode(
        F.when(F.length("content") > 0, F.split(body, LINE_BREAK_RE, -1))
        .otherwise(F.array().cast("array<string>"))).alias("i", "text"))
    lines = lines.select("root_rank", "rel_path", (F.col("i") + 1).alias("n"), "text",
                         _count(F.col("text"), "{").alias("opens"),
                         _count(F.col("text"), "}").alias("closes"))
    lines = lines.select(
        "*",
        F.col("text").rlike(CLASS_RE).alias("is_class"),
        F.when(F.col("text").rlike(CLASS_RE), F.regexp_extract("text", CLASS_RE, 3)).alias("class_name"),
        F.col("text").rlike(METHOD_RE).alias("is_method"),
        F.col("text").rlike(IMPORT_RE).alias("is_import"),
        F.col("text").rlike(FIELD_RE).alias("is_field"))
    file = Window.partitionBy("root_rank", "rel_path")
    w = file.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    back = file.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return lines.select(
        "*",
        F.sum(F.col("closes") - F.col("opens")).over(w).alias("p"),
        F.last("class_name", ignorenulls=True).over(w).alias("enclosing"),
        F.last(F.when(F.col("opens") > 0, F.col("n")), ignorenulls=True).over(back).alias("opened"),
        F.max("n").over(file).alias("size"),
        F.min(F.when(F.col("is_class"), F.col("n"))).over(file).alias("head"))


# ---------------------------------------------------------------- C1-C8

def _next_at_level(lines: DataFrame, asked: DataFrame, fk: list[str]) -> DataFrame:
    """For each row of ``asked`` (file, ``lvl``, ``pos``, ``q``) the first line
    from ``pos`` on at whose end the brace sum is ``lvl``, as ``at``; null if
    there is none. A running window within (file, level), from the last line
    back."""
    events = (lines.select(*fk, F.col("p").alias("lvl"), F.col("n").alias("pos"), F.lit(1).alias("kind"),
                           F.col("n").alias("at"), F.lit(None).cast("int").alias("q"))
              .unionByName(asked.select(*fk, "lvl", "pos", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("at"), "q")))
    back = (Window.partitionBy(*fk, "lvl").orderBy(F.desc("pos"), F.desc("kind"))
            .rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("at", F.last("at", ignorenulls=True).over(back)).filter("kind = 0").select(*fk, "q", "at")


def block_extents(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of files as intervals, from the lines of `file_lines`:

    methods ``(file, m, method_name, lvl, end)``, one row a method line ``m``
    at depth ``lvl`` before it, ending on the line that brings the depth back
    after a brace was opened (C6);
    classes ``(file, class_name, first, lvl, end)``, one row a name, from the
    first line that declares it (C7).

    Blocks that never close end with the file."""
    fk = ["root_rank", "rel_path"]
    marked = lines.withColumn("lvl", F.col("p") - F.col("closes") + F.col("opens"))
    methods = marked.filter("is_method").select(
        *fk, F.col("n").alias("q"), F.regexp_extract("text", METHOD_RE, 4).alias("method_name"), "lvl", "size",
        F.col("opened").alias("pos"))
    ends = _next_at_level(lines, methods.filter(F.col("pos").isNotNull()), fk)
    methods = (methods.join(ends, [*fk, "q"], "left")
               .select(*fk, F.col("q").alias("m"), "method_name", "lvl", F.coalesce("at", "size").alias("end")))
    classes = (marked.filter("is_class").groupBy(*fk, "class_name")
               .agg(F.min_by(F.struct("n", "lvl", "size"), "n").alias("c"))
               .select(*fk, "class_name", F.col("c.n").alias("q"), F.col("c.lvl").alias("lvl"), "c.size", F.col("c.n").alias("pos")))
    # two classes may start on one line only under one name, so (file, line) is a key
    ends = _next_at_level(lines, classes, fk)
    classes = (classes.join(ends, [*fk, "q"], "left")
               .select(*fk, "class_name", F.col("q").alias("first"), "lvl", F.coalesce("at", "size").alias("end")))
    return methods, classes


def _texts(lines: DataFrame, spans: DataFrame, by: list[str], text) -> DataFrame:
    """For each row of ``spans`` (``by``, file, ``lo``, ``hi``) the texts of its
    lines in order, as ``texts``."""
    fk = ["root_rank", "rel_path"]
    at = spans.select(*by, F.explode(F.sequence("lo", "hi")).alias("n"))
    got = at.join(lines.select(*fk, "n", F.col("text").alias("t")), [*fk, "n"])
    listed = got.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("ls"))
    return listed.select(*by, F.transform("ls", lambda x: text(x["t"])).alias("texts"))


def code_context(clusters: DataFrame, sources: DataFrame, n: int = CONTEXT_LINES,
                 keys=("fingerprint",), match: str = "class", materialize: bool = True) -> DataFrame:
    """One row per cluster whose source file is found and whose line is
    inside it: ``file_path, target_line, class_name, method_name,
    start_line, end_line, surrounding_lines, method_start, method_end,
    method_body, imports, class_fields``.

    Each (file, line) is looked up once, whatever the number of clusters
    there: methods and classes are intervals (`block_extents`), a line meets
    them by joins on the file and the depth, and only the lines that a field
    asks for are gathered, so no row ever holds a file. With ``materialize``
    the clusters and the lines of the matched files, read by several joins, are
    checkpointed once to the shared checkpoint folder.
    """
    keys = list(keys)
    clusters = clusters.select(*keys, "primary_class", "primary_file", "primary_line")
    if materialize:
        clusters = checkpoint(clusters)
    found = (match_sources(clusters, sources, keys) if match == "class"
             else match_sources_by_name(clusters, sources, keys))
    fk = ["root_rank", "rel_path"]
    at = [*fk, "L"]
    target = clusters.select(*keys, F.col("primary_line").alias("L")).join(found, keys)
    lines = file_lines(sources.join(found.select(*fk).distinct(), fk, "left_semi"))
    if materialize:
        target, lines = checkpoint(target), checkpoint(lines)
    methods, classes = block_extents(lines)
    if materialize:
        methods, classes = checkpoint(methods), checkpoint(classes)

    # C4 is known for every line of a file
    known = lines.select(*fk, F.col("n").alias("L"), "p", F.col("enclosing").alias("class_name"), "size")
    spots = target.select(*at).distinct().join(known, at)
    spots = spots.withColumn("start_line", F.greatest(F.lit(1), F.col("L") - n)).withColumn(
        "end_line", F.least(F.col("size"), F.col("L") + n))
    if materialize:
        spots = checkpoint(spots)

    # The last method line i <= L whose depth before it is at least P(L): of each such
    # depth of the file the last method at or above L, then the last of these
    levels = methods.select(*fk, "lvl").distinct()
    asked = spots.select(*at, "p").join(levels, fk).filter(F.col("lvl") >= F.col("p"))
    events = (methods.select(*fk, "lvl", F.col("m").alias("pos"), F.lit(0).alias("kind"), "m")
              .unionByName(asked.select(*fk, "lvl", F.col("L").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("m"))))
    upto = Window.partitionBy(*fk, "lvl").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = events.withColumn("m", F.last("m", ignorenulls=True).over(upto)).filter("kind = 1")
    inside = last.groupBy(*fk, F.col("pos").alias("L")).agg(F.max("m").alias("m")).filter("m IS NOT NULL")
    # A body is gathered once a method
    used = methods.join(inside.select(*fk, "m").distinct(), [*fk, "m"], "left_semi")
    bodies = _texts(lines, used.select(*fk, "m", F.col("m").alias("lo"), F.col("end").alias("hi")), [*fk, "m"],
                    lambda t: F.concat(t, F.lit("\n")))
    method = (inside.join(methods, [*fk, "m"]).join(bodies, [*fk, "m"])
              .select(*at, "method_name", F.col("m").alias("method_start"), F.col("end").alias("method_end"),
                      F.array_join("texts", "").alias("method_body")))

    # Surrounding lines; C3: imports up to and including the first class line
    around = _texts(lines, spots.select(*at, F.col("start_line").alias("lo"), F.col("end_line").alias("hi")), at,
                    lambda t: t).withColumnRenamed("texts", "surrounding_lines")
    imports = (lines.filter(F.col("is_import") & (F.col("head").isNull() | (F.col("n") <= F.col("head"))))
               .groupBy(*fk).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ls"))
               .select(*fk, F.transform("ls", lambda x: java_trim(x["text"])).alias("imports")))

    # Fields one level inside the class, from its first line until its end
    wanted = classes.join(spots.select(*fk, "class_name").distinct(), [*fk, "class_name"], "left_semi").withColumn(
        "p", F.col("lvl") - 1)
    fields = (wanted.join(lines.filter("is_field").select(*fk, "p", "n", "text"), [*fk, "p"])
              .filter((F.col("n") >= F.col("first")) & (F.col("n") <= F.col("end")))
              .groupBy(*fk, "class_name").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ls"))
              .select(*fk, "class_name", F.transform("ls", lambda x: java_trim(x["text"])).alias("class_fields")))

    empty = F.array().cast("array<string>")
    context = (spots.join(around, at).join(method, at, "left").join(imports, fk, "left")
               .join(fields, [*fk, "class_name"], "left"))
    return target.join(context, at).select(
        *keys, "root_rank", F.col("rel_path").alias("file_path"), F.col("L").alias("target_line"),
        "class_name", "method_name", "start_line", "end_line", "surrounding_lines", "method_start", "method_end",
        "method_body", F.coalesce("imports", empty).alias("imports"), F.coalesce("class_fields", empty).alias("class_fields"))


def format_context(context: DataFrame) -> DataFrame:
    """``formatted_context``: the surrounding lines as ``%4d | text``,
    the target line marked `` >>> `` and the others five spaces, a newline
    after each; ``plain_context``: the lines joined by newlines."""
    def fmt(x, i):
        n = F.col("start_line") + i
        mark = F.when(n == F.col("target_line"), F.lit(" >>> ")).otherwise(F.lit("     "))
        return F.concat(mark, F.format_string("%4d | ", n), x, F.lit("\n"))
    return (context.withColumn("formatted_context", F.array_join(F.transform("surrounding_lines", fmt), ""))
            .withColumn("plain_context", F.array_join("surrounding_lines", "\n")))
