"""Text logs as a stream (S4): records that go on over files and batches.

A log is a folder of text files, written one after the other and cut
anywhere. Each task folds the lines of its splits into pieces (a header and
the lines after it, or lines that continue what came before). A record that
the next header of its split closes is whole and is spread over all tasks. The
pieces at the edges of splits meet in the log's state, which holds its open
record over micro-batches and closes it by the next header, or by a timer when
nothing follows.
"""

from __future__ import annotations

import sys
import tempfile
import time
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from errorlens.sources.logs import ENTRY, HEAD_START_RE, _parsed

# what runs in tasks travels with them, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = "log string, file string, block long, seq long, headed boolean, whole boolean, text string"
PIECE_COLUMNS = [c.split()[0] for c in PIECES.split(", ")]
RECORDS = "file string, block long, seq long, part int, headed boolean, text string"
#: Characters of an open record that the state holds at most, about.
STATE_CHARS = 4_000_000
#: Bytes of text that a task holds while it puts a log's pieces in order; more go to a temporary file.
SPOOL_BYTES = 16 << 20
#: Characters and rows of an output batch, about.
BATCH_CHARS, BATCH_ROWS = 4_000_000, 10_000
#: Keys that whole records are dealt over, for each shuffle partition.
LANES = 16


def fold_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of a task, in read order, to pieces; a piece ends with its split. It
    is ``whole`` if it begins with a header and the next one follows it."""
    def row(whole=False):
        return (*key, seq, headed, whole, "\n".join(lines))

    key, seq, headed, lines, size = None, 0, False, [], 0
    for pdf in batches:
        out = []
        for log, file, block, head, line in zip(*(pdf[c] for c in ("log", "file", "block", "is_head", "line"))):
            new = key != (log, file, block)
            if key is not None and (new or head or size > STATE_CHARS):
                out.append(row(headed and bool(head) and not new))
                lines, size = [], 0
                seq += 1
                headed = False
            if new:
                key, seq = (log, file, block), 0
            if head:
                headed = True
            lines.append(line)
            size += len(line) + 1
        yield pd.DataFrame(out, columns=PIECE_COLUMNS)
    if key is not None:
        yield pd.DataFrame([row()], columns=PIECE_COLUMNS)


class _InOrder:
    """Pieces that come in any order, given by file, block and seq. Beyond
    `SPOOL_BYTES` their texts stand in a temporary file that has no name."""

    def __init__(self):
        self.texts, self.end = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES), 0
        self.files, self.places = {}, []

    def add(self, pieces: pd.DataFrame) -> None:
        for file, block, seq, headed, text in zip(*(pieces[c] for c in ("file", "block", "seq", "headed", "text"))):
            raw = text.encode("utf-8", "surrogatepass")
            self.texts.write(raw)
            self.places.append((self.files.setdefault(file, file), int(block), int(seq), bool(headed), self.end, len(raw)))
            self.end += len(raw)

    def given(self) -> Iterator[tuple[str, int, int, bool, str]]:
        self.places.sort(key=itemgetter(0, 1, 2))
        for *place, at, n in self.places:
            self.texts.seek(at)
            yield *place, self.texts.read(n).decode("utf-8", "surrogatepass")


class OpenRecord(StatefulProcessor):
    """The open record of each log."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "file string, block long, seq long, part int, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        edges = _InOrder()
        with edges.texts:
            for pieces in rows:
                if "whole" in pieces:
                    whole = pieces["whole"].astype(bool)
                    if whole.any():
                        yield _whole(pieces[whole])
                    pieces = pieces[~whole]
                edges.add(pieces)
            if edges.places:
                yield from self._followed(edges, timerValues)

    def _followed(self, edges: _InOrder, timerValues) -> Iterator[pd.DataFrame]:
        """The records that the edges of a log's splits close, after the open one."""
        now, held, size, out, chars = None, [], 0, [], 0   # the open record's place and part, and its text so far
        if self.open.exists():
            *now, text = self.open.get()
            held = [] if text is None else [text]
            size = len(text or "")
        for file, block, seq, headed, text in edges.given():
            chars += len(text)
            if headed:
                if held:
                    out.append((*now, True, "\n".join(held)))
                now, held, size = [file, block, seq, 0], [text], len(text)
            elif now is None:
                out.append((file, block, seq, 0, False, text))
            else:
                held.append(text)
                size += len(text) + 1
            if size > STATE_CHARS and now is not None:
                out.append((*now, True, "\n".join(held)))
                now, held, size = [*now[:3], now[3] + 1], [], 0
            if chars > BATCH_CHARS or len(out) >= BATCH_ROWS:
                yield _rows(out)
                out, chars = [], 0
        if now is not None:
            self.open.update((*now, "\n".join(held) if held else None))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            *now, text = self.open.get()
            if text is not None:
                out.append((*now, True, text))
            self.open.clear()
        yield _rows(out)

    def close(self) -> None:
        pass


def _whole(pieces: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"file": pieces["file"], "block": pieces["block"].astype("int64"), "seq": pieces["seq"].astype("int64"),
                         "part": pd.Series(0, index=pieces.index, dtype="int32"), "headed": True, "text": pieces["text"]})


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"file": pd.Series([r[0] for r in out], dtype=object),
                         "block": pd.Series([r[1] for r in out], dtype="int64"),
                         "seq": pd.Series([r[2] for r in out], dtype="int64"),
                         "part": pd.Series([r[3] for r in out], dtype="int32"),
                         "headed": pd.Series([r[4] for r in out], dtype=bool),
                         "text": pd.Series([r[5] for r in out], dtype=object)})


def folder_of(file: Column) -> Column:
    return F.regexp_replace(file, r"[^/]*\z", "")


def stream_log_files(spark: SparkSession, path: str, log_of=folder_of, timeout: float = 30.0,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Text logs in folders below ``path`` as an unbounded table: a row
    for each record or rejected line, ``(kind, reason, timestamp,
    thread_name, level, logger, message, stack_trace, text, file, block, seq,
    part)``, kinds and reasons as in `scan_log_files`; block and seq tell
    where the record's header stands (split, place in it).

    The files of one log (``log_of`` their path; by default a folder) are one
    text, in the order of their names; they have to arrive in that order. A
    record that a file or micro-batch ends inside goes on in the next one. It
    is given when the next header comes, or after ``timeout`` seconds without
    one; lines that come later still are leading lines. A record too long for
    the state is given in parts (``fragment``).

    A task holds a bounded part of the text, however much a micro-batch has:
    whole records pass through, spread over all tasks; of a log's other pieces
    only the places are in memory.

    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`),
    as every `transformWithState` does, and a processing-time trigger."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true").option("latestFirst", "false")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", r"\r\z", "").alias("line"))
    lines = lines.select(log_of(F.col("file")).alias("log"), "file", "block", F.col("line").rlike(HEAD_START_RE).alias("is_head"), "line")
    pieces = lines.mapInPandas(fold_lines, PIECES)
    # whole records need no state; keys of their own (no path has a zero character) spread them over the tasks
    lanes = LANES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lane = F.concat(F.lit("\0"), F.pmod(F.xxhash64("file", "block", "seq"), F.lit(lanes)).cast("string"))
    pieces = pieces.withColumn("log", F.when(F.col("whole"), lane).otherwise(F.col("log")))
    records = pieces.groupBy("log").transformWithStateInPandas(
        OpenRecord(int(timeout * 1000)), outputStructType=RECORDS, outputMode="append", timeMode="ProcessingTime")
    text = F.regexp_replace("text", r"\n+\z", "")
    rows = records.withColumn("text", F.explode(F.when(F.col("headed"), F.array(text)).otherwise(F.split("text", "\n", -1))))
    rows = _parsed(rows, "text")
    kind = (F.when(~F.col("headed"), F.lit("reject")).when(F.col("part") > 0, F.lit("fragment"))
            .when(F.col("reason").isNotNull(), F.lit("reject")).otherwise(F.lit("entry")))
    rows = rows.withColumn("kind", kind)
    of_entry = [F.when(F.col("kind") == "entry", F.col(c)).alias(c) for c in ENTRY]
    return rows.select("kind", F.when(~F.col("headed"), F.lit("leading")).when(F.col("kind") == "reject", F.col("reason")).alias("reason"),
                       *of_entry, F.when(F.col("kind") != "entry", F.col("text")).alias("text"), "file", "block", "seq", "part")


def start_log_stream(entries: DataFrame, sink_path: str, checkpoint: str, trigger: str = "5 seconds"):
    """Append rows of `stream_log_files` to a Parquet folder, with the state
    store it needs; the session's own setting is put back."""
    spark, name = entries.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (entries.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(processingTime=trigger).start())
        while query.isActive and query.lastProgress is None:   # the setting is read when the first batch is planned
            time.sleep(0.2)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return query


def run_until_closed(query, poll: float = 0.5) -> None:
    """Wait until a query on `stream_log_files` has read all files that are
    there and its timers have closed every record; then stop it."""
    while query.isActive:
        progress = query.lastProgress
        state = (progress or {}).get("stateOperators") or []
        if state and progress["numInputRows"] == 0 and state[0]["numRowsTotal"] == 0:
            break
        time.sleep(poll)
    if query.exception() is not None:
        raise query.exception()
    query.stop()
