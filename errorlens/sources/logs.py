"""Log table readers and writers.

The canonical log table is Parquet laid out by ``log_date`` so time filters
prune whole folders, with columns as in ``schema.LOG_SCHEMA``. Text log files
are folded into entries with column expressions; nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errorlens.functions.levels import normalize_level
from errorlens.functions.mdc import parse_mdc
from errorlens.schema import LOG_SCHEMA

# The row forms the reference's stores hand out.
STORE_TEXT_SCHEMA = ("id bigint, timestamp bigint, level string, logger string, message string, "
                     "stack_trace string, file_name string, line_number int, method_name string, "
                     "class_name string, trace_id string, thread_name string, mdc_context string, "
                     "created_at bigint")


def to_log_schema(df: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """S1 mapping: any store row form to the canonical columns.

    Epoch-millisecond times become timestamps, ISO text times are parsed,
    the level is made canonical (null reads as INFO), a ``k=v;k=v`` or
    JSON-object context becomes a map. Missing columns read as null.
    """
    out = []
    for field in LOG_SCHEMA.fields:
        name, dtype = field.name, field.dataType
        if name not in df.columns:
            out.append(F.lit(None).cast(dtype).alias(name))
            continue
        src = df.schema[name].dataType.simpleString()
        c = F.col(name)
        if name in ("timestamp", "created_at"):
            if src in ("bigint", "int"):
                c = F.timestamp_millis(c)
            elif src == "string":
                c = F.try_to_timestamp(c)
            c = c.cast("timestamp")
        elif name == "level":
            c = normalize_level(c)
        elif name == "mdc_context" and src == "string":
            c = F.when(F.trim(c).startswith("{"), F.from_json(c, "map<string,string>")).otherwise(parse_mdc(c))
        out.append(c.cast(dtype).alias(name))
    return df.select(*out, *keep)


# The JSON row form of the hosted store and of its ingest API: times as ISO
# text, the context as a JSON object.
JSON_ROW_SCHEMA = ("id bigint, app_id string, timestamp string, level string, logger string, "
                   "message string, stack_trace string, file_name string, line_number int, "
                   "method_name string, class_name string, trace_id string, thread_name string, "
                   "mdc_context map<string,string>, created_at string")


def from_json_rows(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON log rows held in a text or binary column (a JSON file
    read as text, a Kafka topic's ``value``) to the canonical columns."""
    text = F.col(col).cast("string")
    parsed = df.select(F.from_json(text, JSON_ROW_SCHEMA).alias("_r")).select("_r.*")
    return to_log_schema(parsed)


def read_logs(spark: SparkSession, path: str | None, fmt: str = "parquet", schema=None,
              **options) -> DataFrame:
    """Scan a stored log table into the canonical columns.

    ``fmt`` is any Spark source (``parquet``, ``json``, ``orc``, ``csv``,
    ``jdbc`` with its ``url``/``dbtable``/``partitionColumn`` options...); a
    schema is passed so nothing is inferred. Every table is mapped, so that
    raw levels and text times never reach an operator; the day folder
    (``log_date``) is kept for partition pruning.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path) if path is not None else reader.load()
    return to_log_schema(df, keep=[c for c in df.columns if c == "log_date"])


def with_ingest_defaults(df: DataFrame, now: Column | None = None, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """S2 defaults: a null time becomes the ingest time, a null level INFO,
    ``created_at`` the ingest time; ``log_date`` is added for the layout."""
    at = now if now is not None else F.current_timestamp()
    out = to_log_schema(df, keep)
    out = (out.withColumn("timestamp", F.coalesce("timestamp", at))
              .withColumn("level", F.coalesce("level", F.lit("INFO")))
              .withColumn("created_at", F.coalesce("created_at", at)))
    return out.withColumn("log_date", F.to_date("timestamp"))


def write_logs(df: DataFrame, path: str, now: Column | None = None, mode: str = "append") -> None:
    """Append a batch to the canonical table, one folder per day, rows
    sorted by app and time inside each file (small row groups to skip)."""
    out = with_ingest_defaults(df, now)
    # a day larger than a partition should be is split, others are put together
    (out.hint("rebalance", F.col("log_date")).sortWithinPartitions("log_date", "app_id", "timestamp")
        .write.mode(mode).partitionBy("log_date").parquet(path))


def day_folders(spark: SparkSession, path: str) -> list[str]:
    """The days of a table that `write_logs` wrote, newest first; only folder
    names are listed."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [st.getPath().getName() for st in fs.listStatus(base)] if fs.exists(base) else []
    return sorted((x[len("log_date="):] for x in names if x.startswith("log_date=") and x[9:10].isdigit()), reverse=True)


def delete_older_than_on_disk(spark: SparkSession, path: str, cutoff: str) -> int:
    """U3 on the day-partitioned table: rows with ``timestamp < cutoff`` go.

    Whole ``log_date`` folders before the cutoff day are removed; the
    cutoff day itself is rewritten without the older rows into a staging
    folder that then takes the old folder's place by two renames; a run that
    stopped half way is finished by the next one. Returns how many rows were
    dropped. Only folder names are listed on the driver.
    """
    from pyspark.sql.functions import col, lit
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    day = cutoff[:10]
    table = spark.read.parquet(path)
    bound = lit(cutoff).cast(table.schema["timestamp"].dataType)
    # days after the cutoff's have no such rows
    dropped = table.filter((col("log_date") <= lit(day).cast("date")) & (col("timestamp") < bound)).count()
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if name.startswith("log_date=") and name[len("log_date="):] < day:
            fs.delete(st.getPath(), True)
    Path = jvm.org.apache.hadoop.fs.Path
    edge = Path(base, f"log_date={day}")
    fresh, old = Path(base, f"_rewrite_log_date={day}"), Path(base, f"_old_log_date={day}")
    # finish a swap a failed run left half done: data is in exactly one place
    if not fs.exists(edge):
        if fs.exists(fresh):
            fs.rename(fresh, edge)
        elif fs.exists(old):
            fs.rename(old, edge)
    if fs.exists(edge):
        (spark.read.parquet(edge.toString()).filter(col("timestamp") >= bound)
         .write.mode("overwrite").parquet(fresh.toString()))
        fs.rename(edge, old)      # folder renames: the day is always in edge, old or fresh
        fs.rename(fresh, edge)
        fs.delete(old, True)
    return dropped


# ---------------------------------------------------------------- S3: text log files

# The line layout ``yyyy-MM-dd HH:mm:ss.SSS [thread] LEVEL logger - message``.
HEADER_RE = r"\A(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) \[([^\]]*)\] (\S+) +(\S+) - (.*)\z"
RECORD_SPLIT_RE = r"\n(?=\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} \[)"


def format_log_lines(logs: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Canonical rows to text records in the layout above (trace lines
    follow the message line); one ``value`` per record for ``write.text``,
    after the columns ``keep``."""
    trace = F.regexp_replace("stack_trace", r"\n+\z", "")
    return logs.select(*keep, F.concat(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["),
        F.coalesce("thread_name", F.lit("")), F.lit("] "), F.rpad("level", 5, " "), F.lit(" "),
        F.coalesce("logger", F.lit("-")), F.lit(" - "), F.coalesce("message", F.lit("")),
        F.coalesce(F.when(F.length(trace) > 0, F.concat(F.lit("\n"), trace)), F.lit(""))
    ).alias("value"))


def _parsed(records: DataFrame, text: str) -> DataFrame:
    """``records`` with the header fields of ``text``, and ``reason``: null for
    an entry, ``header`` if the first line does not fit the layout, ``date``
    if its time is no time."""
    first = F.substring_index(F.col(text), "\n", 1)
    rest = F.when(F.instr(text, "\n") > 0, F.substr(F.col(text), F.instr(text, "\n") + 1))
    out = records.withColumn("_h", first).withColumn("_t", rest).withColumn("_fits", F.col("_h").rlike(HEADER_RE))
    field = lambda k: F.when(F.col("_fits"), F.regexp_extract("_h", HEADER_RE, k))
    out = out.withColumns({
        "timestamp": F.try_to_timestamp(field(1), F.lit("yyyy-MM-dd HH:mm:ss.SSS")), "thread_name": field(2),
        "level": F.when(F.col("_fits"), normalize_level(field(3))), "logger": field(4), "message": field(5),
        "stack_trace": F.when(F.col("_fits") & (F.length("_t") > 0), F.col("_t"))})
    reason = F.when(~F.col("_fits"), F.lit("header")).when(F.col("timestamp").isNull(), F.lit("date"))
    return out.withColumn("reason", reason).drop("_h", "_t", "_fits")


ENTRY = ["timestamp", "thread_name", "level", "logger", "message", "stack_trace"]


def scan_log_files(spark: SparkSession, path: str, split_bytes: int | None = None,
                   fragment_bytes: int | None = None) -> DataFrame:
    """S3: everything in text logs from one pass over their bytes, without a
    shuffle: a row for each piece, ``(kind, reason, timestamp, thread_name,
    level, logger, message, stack_trace, text, file, pos, part)``.

    ``entry``: a record whose header fits, in the entry columns. ``reject``:
    a record whose header does not fit or has an impossible date (``reason``
    ``header`` or ``date``; ``text`` is the record), or a line before the
    first header of its file (``leading``, a row each). ``fragment``: lines
    of a record longer than ``fragment_bytes``, by ``part`` from 1 (``text``);
    its entry or reject has the first part. ``pos`` is the byte where the
    record's header begins. Files are read by ranges of ``split_bytes``."""
    from errorlens.sources import log_text as LT
    pieces = LT.log_pieces(spark, path, split_bytes or LT.SPLIT_BYTES, fragment_bytes or LT.FRAGMENT_BYTES)
    if pieces is None:
        raise ValueError(f"tasks can't open {path}; read_log_files(..., how='lines') reads it through Spark")
    rows = pieces.withColumn("text", F.col("text").cast("string"))
    # a leading piece is a row a line, any other piece one row
    lines = F.when(F.col("headed"), F.array("text")).otherwise(F.split("text", "\n", -1))
    rows = rows.withColumn("text", F.explode(lines))
    rows = _parsed(rows, "text")
    kind = (F.when(~F.col("headed"), F.lit("reject")).when(F.col("part") > 0, F.lit("fragment"))
            .when(F.col("reason").isNotNull(), F.lit("reject")).otherwise(F.lit("entry")))
    rows = rows.withColumn("kind", kind)
    reason = F.when(~F.col("headed"), F.lit("leading")).when(F.col("kind") == "reject", F.col("reason"))
    of_entry = [F.when(F.col("kind") == "entry", F.col(c)).alias(c) for c in ENTRY]
    text = F.when(F.col("kind") != "entry", F.col("text")).alias("text")
    return rows.select("kind", reason.alias("reason"), *of_entry, text, "file", "pos", "part")


def _records_to_entries(records: DataFrame) -> DataFrame:
    return _parsed(records, "record").where(F.col("reason").isNull()).select(*ENTRY, "file", "pos")


HEAD_START_RE = r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} \["


def _tag_split_lines(batches):
    """Per partition, in read order: number the lines of each input split
    (``seq``) and the header lines in it (``rec``; -1 before the first
    header of the split). Counters carry over Arrow batches."""
    import numpy as np
    import pandas as pd
    prev_key, seq0, rec0 = None, 0, -1
    for pdf in batches:
        if pdf.empty:
            continue
        key = pdf["file"].astype(str) + "\x00" + pdf["block"].astype(str)
        new = key.ne(key.shift()).to_numpy()
        new[0] = key.iloc[0] != prev_key
        split = np.cumsum(new)
        head = pdf["is_head"].to_numpy().astype(np.int64)
        seq = pd.Series(np.ones(len(pdf), dtype=np.int64)).groupby(split).cumsum().to_numpy() - 1
        rec = pd.Series(head).groupby(split).cumsum().to_numpy() - 1
        if not new[0]:  # the first split continues from the previous batch
            first = split == split[0]
            seq[first] += seq0
            rec[first] += rec0 + 1
        last = split == split[-1]
        prev_key, seq0, rec0 = key.iloc[-1], int(seq[last][-1]) + 1, int(rec[last][-1])
        yield pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "seq": seq, "rec": rec,
                            "line": pdf["line"]})


def _how(spark: SparkSession, path: str, whole_files: bool, how: str | None) -> str:
    if how or whole_files:
        return how or "whole"
    from errorlens.sources.log_text import OPENED, listed_files
    opened = all(f.split(":", 1)[0] in OPENED for f, _ in listed_files(spark, path))
    return "ranges" if opened else "lines"


def read_log_files(spark: SparkSession, path: str, whole_files: bool = False, how: str | None = None,
                   split_bytes: int | None = None) -> DataFrame:
    """S3: text log files to entries ``(timestamp, thread_name, level,
    logger, message, stack_trace, file, pos)``; a record is a header line
    (timestamp and ``[``) and the lines up to the next header. What is no
    entry is in `read_log_rejects`.

    ``how``, by default ``ranges`` where tasks can open the store, else
    ``lines``:

    ``ranges``: byte ranges (`scan_log_files`): one pass, no shuffle, any
    size of file and record.

    ``lines``: through Spark's text reader, for stores that only it reads.
    Each split numbers its lines and headers in read order (Arrow batches);
    lines before a split's first header continue the last record of the
    nearest earlier split of the file, found in a table of one row per split;
    records are assembled by a group-by on the record key.

    ``whole`` (``whole_files``): each file is one row cut into records by a
    look-ahead split; simpler, for files well below the 2 GB string limit.
    """
    how = _how(spark, path, whole_files, how)
    if how == "ranges":
        return scan_log_files(spark, path, split_bytes).where("kind = 'entry'").select(*ENTRY, "file", "pos")
    return _records_to_entries(_records(spark, path, how == "whole")[0])


def read_log_rejects(spark: SparkSession, path: str, whole_files: bool = False, how: str | None = None,
                     split_bytes: int | None = None) -> DataFrame:
    """S3: what `read_log_files` takes for no entry, as ``(file, pos, text,
    reason)``. ``header``: a record, with all its lines, whose first line
    begins as a header but does not fit the layout; ``date``: its time is no
    time; ``pos`` is the record's. ``leading``: a line before the first header
    of its file, a row each."""
    how = _how(spark, path, whole_files, how)
    if how == "ranges":
        return scan_log_files(spark, path, split_bytes).where("kind = 'reject'").select("file", "pos", "text", "reason")
    records, leading = _records(spark, path, how == "whole")
    unfit = _parsed(records, "record").where(F.col("reason").isNotNull())
    return (unfit.select("file", "pos", F.col("record").alias("text"), "reason")
            .unionByName(leading.withColumn("reason", F.lit("leading"))))


def _records(spark: SparkSession, path: str, whole_files: bool) -> tuple[DataFrame, DataFrame]:
    """(file, pos, record) of all records and (file, pos, text) of the lines
    before the first header of their file."""
    if whole_files:
        files = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), F.col("value"))
        recs = files.select("file", F.posexplode(F.split(
            F.regexp_replace("value", r"\r\n", "\n"), RECORD_SPLIT_RE, -1)).alias("pos", "record"))
        headed = F.col("record").rlike(HEAD_START_RE)
        lead = recs.filter(~headed & (F.length("record") > 0)).select(
            "file", "pos", F.explode(F.split(F.regexp_replace("record", r"\n\z", ""), "\n", -1)).alias("text"))
        recs = recs.filter(headed).withColumn("record", F.regexp_replace("record", r"\n+\z", ""))
        return recs, lead
    from pyspark.sql import Window
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", r"\r\z", "").alias("line"))
    lines = lines.withColumn("is_head", F.col("line").rlike(HEAD_START_RE))
    tagged = lines.mapInPandas(_tag_split_lines,
                               "file string, block long, seq long, rec long, line string")
    splits = tagged.groupBy("file", "block").agg(F.max("rec").alias("last_rec"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = splits.select("file", "block", F.last(F.when(F.col("last_rec") >= 0, F.struct(
        F.col("block").alias("b"), F.col("last_rec").alias("r"))), ignorenulls=True).over(w).alias("carry"))
    keyed = tagged.join(carry, ["file", "block"]).select(
        "file", "block", "seq", "line",
        F.when(F.col("rec") >= 0, F.col("block")).otherwise(F.col("carry.b")).alias("kb"),
        F.when(F.col("rec") >= 0, F.col("rec")).otherwise(F.col("carry.r")).alias("kr"))
    recs = (keyed.filter(F.col("kr").isNotNull()).groupBy("file", "kb", "kr").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "line"))),
                                 lambda x: x["line"]), "\n").alias("record"))
            .select("file", F.struct("kb", "kr").alias("pos"), "record"))
    lead = keyed.filter(F.col("kr").isNull()).select(
        "file", F.struct(F.col("block").alias("kb"), F.col("seq").alias("kr")).alias("pos"), F.col("line").alias("text"))
    return recs.withColumn("record", F.regexp_replace("record", r"\n+\z", "")), lead


# ---------------------------------------------------------------- S4

def stream_logs(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """The same records as an unbounded source (new files in a folder).
    The schema is fixed up front, as a streaming file source requires."""
    reader = spark.readStream.format(fmt).schema(schema or LOG_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
