"""Pattern samples of the stored log table that skip data files.

Beside the table that `write_logs` wrote stands an index: of each data file a
Bloom filter of the (application, run of three characters) pairs that the
messages of its error rows hold. A file without one of a pattern's runs has no
match of the pattern, so it isn't opened. A filter can name a file too many,
never one too few.

Layout::

    base/grams/b=<batch>/    file, m, word, bits: the words of the filters that aren't zero
    base/files/v=NNNNNN/     file, length, modified, b

A filter has ``m`` bits, a power of two of at least 16 for each of the file's
pairs, so its share of set bits is the same for small and large files.
``files`` is written last and names the batch that holds a file's filter. A
data file that it doesn't name, or names with another length or time, is
always read, so a late index costs time and loses nothing. One job refreshes
an index at a time; readers may run meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errorlens.functions.levels import is_error
from errorlens.operators.insight import GRAM, _grams, sample_logs_by_pattern, stored_pattern
from errorlens.operators.sizes import broadcast_if_small
from errorlens.operators.state import _fs, read_snapshot, write_snapshot
from errorlens.schema import LOG_SCHEMA
from errorlens.session import checkpoint
from errorlens.sources.logs import day_folders, to_log_schema

#: Bits of a filter for each (application, run) pair of its file.
BITS = 16
KEY = ["file", "length", "modified"]
FILES = "file string, length long, modified timestamp, b string"
GRAMS = "file string, m long, word long, bits long, b string"


def _relative(path: Column) -> Column:
    return F.regexp_extract(path, r"(log_date=[^/]+/[^/]+)$", 1)


def data_files(spark: SparkSession, logs_path: str) -> DataFrame:
    """``file, length, modified`` of the table's data files; Spark lists them,
    none is opened."""
    if not day_folders(spark, logs_path):
        return spark.createDataFrame([], FILES).drop("b")
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .load(f"{logs_path.rstrip('/')}/log_date=*"))
    return found.select(_relative(F.col("path")).alias("file"), "length", F.col("modificationTime").alias("modified"))


def read_data_files(spark: SparkSession, logs_path: str, files: list[str]) -> DataFrame:
    """The log rows of some data files, with ``log_date`` and ``file``."""
    path = logs_path.rstrip("/")
    if not files:
        return spark.createDataFrame([], LOG_SCHEMA).select(
            "*", F.lit(None).cast("date").alias("log_date"), F.lit("").alias("file"))
    df = spark.read.option("basePath", path).parquet(*[f"{path}/{f}" for f in files])
    return to_log_schema(df.withColumn("file", _relative(F.col("_metadata.file_path"))), keep=["log_date", "file"])


def _bits(h: Column, m: Column) -> Column:
    """The two places of a pair's hash in a filter of ``m`` bits."""
    low = (m - 1).cast("long")
    return F.array(h.bitwiseAND(low), F.shiftrightunsigned(h, 32).bitwiseAND(low))


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def gram_filters(logs: DataFrame) -> DataFrame:
    """``file, m, word, bits`` of log rows with their ``file``. The pairs of a
    file are made distinct in the map tasks first; what is shuffled is a hash
    for each pair, no message."""
    rows = logs.filter(is_error("level") & F.col("message").isNotNull() & F.col("app_id").isNotNull())
    gram = F.explode(_grams(F.lower("message"), GRAM)).alias("gram")
    pairs = checkpoint(rows.select("file", "app_id", gram).select("file", F.xxhash64("app_id", "gram").alias("h")).distinct())
    sizes = pairs.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select(
        "file", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") * BITS, F.lit(64))))).cast("long").alias("m"))
    placed = pairs.join(broadcast_if_small(sizes), "file").select("file", "m", F.explode(_bits(F.col("h"), F.col("m"))).alias("bit"))
    return placed.groupBy("file", "m", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(_mask(F.col("bit"))).alias("bits"))


def _held(spark: SparkSession, base: str) -> DataFrame:
    held = read_snapshot(spark, f"{base}/files")
    return spark.createDataFrame([], FILES) if held is None else held


def refresh_gram_index(spark: SparkSession, logs_path: str, base: str) -> int:
    """Bring the index up to date with the table and return how many data
    files were read: the ones that are new or changed. Files that are gone
    leave the list. File names go through the driver, no rows."""
    base = base.rstrip("/")
    now, held = checkpoint(data_files(spark, logs_path)), _held(spark, base)
    fresh = [r[0] for r in now.join(held, KEY, "left_anti").select("file").collect()]
    if not fresh and held.join(now, KEY, "left_anti").isEmpty():
        return 0
    batch = f"x{uuid.uuid4().hex}"
    if fresh:
        filters = gram_filters(read_data_files(spark, logs_path, fresh))
        filters.sortWithinPartitions("m", "word").write.mode("overwrite").parquet(f"{base}/grams/b={batch}")
    listed = checkpoint(now.join(held, KEY, "left").withColumn("b", F.coalesce("b", F.lit(batch))))
    used = {r[0] for r in listed.select("b").unionByName(held.select("b")).distinct().collect()}
    write_snapshot(listed, f"{base}/files")
    # batches that neither this list nor the one before it (a reader may hold it) names
    fs, p, _ = _fs(spark, f"{base}/grams")
    for st in fs.listStatus(p) if fs.exists(p) else []:
        if st.getPath().getName().removeprefix("b=") not in used:
            fs.delete(st.getPath(), True)
    return len(fresh)


def pattern_grams(pattern: Column) -> Column:
    """The runs of three characters of a pattern's literal pieces, lower-cased:
    every message that matches holds them all. Empty where no piece is long
    enough."""
    pieces = F.split(F.lower(pattern), "[%_]")
    return F.array_distinct(F.flatten(F.transform(pieces, lambda x: _grams(x, GRAM))))


def matching_files(spark: SparkSession, base: str, patterns: DataFrame) -> DataFrame:
    """``app_id, fingerprint, file, length, modified``: for each row of
    ``patterns`` (``app_id, fingerprint, grams``, not empty) the indexed files
    whose filter has all its bits. Patterns and filters meet by an equi-join on
    (m, word); the sizes ``m`` are powers of two, a few tens at most."""
    base = base.rstrip("/")
    files = _held(spark, base)
    fs, p, _ = _fs(spark, f"{base}/grams")
    # a batch folder without rows has no files to infer a schema from: it is given
    words = (spark.read.schema(GRAMS).parquet(f"{base}/grams") if fs.exists(p) else spark.createDataFrame([], GRAMS))
    sizes = [r[0] for r in words.select("m").distinct().collect()]
    if not sizes:
        return patterns.limit(0).select("app_id", "fingerprint", *[F.lit(None).cast(files.schema[x].dataType).alias(x) for x in KEY])
    each = patterns.filter(F.col("app_id").isNotNull()).select(
        "app_id", "fingerprint", F.explode("grams").alias("gram"),
        F.array(*[F.lit(m).cast("long") for m in sizes]).alias("m"))
    each = each.select("app_id", "fingerprint", F.xxhash64("app_id", "gram").alias("h"), F.explode("m").alias("m"))
    bits = each.select("app_id", "fingerprint", "m", F.explode(_bits(F.col("h"), F.col("m"))).alias("bit"))
    asked = (bits.groupBy("app_id", "fingerprint", "m", F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(_mask(F.col("bit"))).alias("mask"))
             .groupBy("app_id", "fingerprint", "m").agg(F.collect_list(F.struct("word", "mask")).alias("all"))
             .select("app_id", "fingerprint", "m", F.size("all").alias("n"), F.inline("all")))
    met = words.join(broadcast_if_small(checkpoint(asked)), ["m", "word"]).filter(
        F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    whole = met.groupBy("app_id", "fingerprint", "file", "b", "n").count().filter("count = n")
    return whole.join(files, ["file", "b"]).select("app_id", "fingerprint", *KEY)


def sample_logs_stored(spark: SparkSession, clusters: DataFrame, logs_path: str, base: str, k: int = 3,
                       prefix: int | None = None, tokens_as_wildcards: bool = False) -> DataFrame:
    """J5 on the stored table with its index: the rows of
    `sample_logs_by_pattern` over the whole table. Opened are the files whose
    filter has all runs of at least one pattern, and files that the index
    doesn't know in their present form.

    Patterns without a piece of three characters (null, empty, wildcards only)
    can't be looked up; for them the whole table is read, as they match about
    everywhere. An index that was never made, or is late, gives the same rows."""
    c = checkpoint(clusters.select("app_id", "cluster_id", "fingerprint", "message_pattern",
                                   pattern_grams(stored_pattern(prefix, tokens_as_wildcards)).alias("grams")))
    now, asked = checkpoint(data_files(spark, logs_path)), c.filter(F.size("grams") > 0)
    known = checkpoint(now.join(_held(spark, base.rstrip("/")), KEY, "left_semi"))
    chosen = (matching_files(spark, base, asked.select("app_id", "fingerprint", "grams")).select(*KEY).distinct()
              .join(known, KEY, "left_semi").unionByName(now.join(known, KEY, "left_anti")))
    names = sorted(r[0] for r in chosen.select("file").collect())
    out = sample_logs_by_pattern(asked, read_data_files(spark, logs_path, names), k, prefix, tokens_as_wildcards)
    rest = c.filter(F.size("grams") == 0)
    if rest.isEmpty():
        return out
    everything = read_data_files(spark, logs_path, sorted(r[0] for r in now.select("file").collect()))
    return out.unionByName(sample_logs_by_pattern(rest, everything, k, prefix, tokens_as_wildcards))
