"""Text logs read by byte ranges (S3), one pass and no shuffle.

A file is cut into byte ranges. A record belongs to the range in which its
header begins; its task reads on past the end of the range to the next
header, and skips what comes before its own first header. So every record is
made whole in one task, only edges are read twice, and a record longer than
``fragment_bytes`` is given as numbered parts instead of one string.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# what runs in tasks travels with them, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "file string, pos long, part int, headed boolean, text binary"
#: Bytes of a range, bytes read at a time, bytes of a record's part at most (about).
SPLIT_BYTES, BLOCK_BYTES, FRAGMENT_BYTES = 64 << 20, 4 << 20, 16 << 20
#: Text bytes of an output batch, about.
BATCH_BYTES = 8 << 20
#: Stores that the tasks can open; paths of others are read by `read_log_files` through Spark.
OPENED = ("file", "s3", "s3a", "gs", "hdfs", "abfs")

# The begin of a header line, ``yyyy-MM-dd HH:mm:ss.SSS [``, after a line end.
HEAD = re.compile(rb"\n(?=\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} \[)")
HEAD_BYTES = 25


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class _Record:
    """The record that is being read."""

    def __init__(self, pos: int, headed: bool, fragment_bytes: int):
        self.pos, self.headed, self.most = pos, headed, fragment_bytes
        self.part, self.chunks, self.size, self.full = 0, [], 0, fragment_bytes

    def add(self, raw: bytes) -> Iterator[tuple]:
        self.chunks.append(raw)
        self.size += len(raw)
        if self.size < self.full:
            return
        # parts end at a line end; a line is never cut
        whole, done = b"".join(self.chunks), 0
        while len(whole) - done >= self.most:
            at = whole.rfind(b"\n", done + 1, done + self.most)
            at = at if at > 0 else whole.find(b"\n", done + self.most)
            if at < 0:
                break
            yield self._row(whole[done:at])
            self.part, done = self.part + 1, at + 1
        rest = whole[done:]
        self.chunks, self.size, self.full = [rest], len(rest), max(self.most, 2 * len(rest))

    def close(self) -> Iterator[tuple]:
        text = b"".join(self.chunks).replace(b"\r\n", b"\n")
        text = (text[:-1] if text.endswith(b"\r") else text).rstrip(b"\n")
        if text or not self.part and self.headed:
            yield self._row(text)

    def _row(self, text: bytes) -> tuple:
        return self.pos, self.part, self.headed, text.replace(b"\r\n", b"\n")


def records(f: BinaryIO, start: int, end: int, fragment_bytes: int = FRAGMENT_BYTES,
            block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, bool, bytes]]:
    """(pos, part, headed, text) of the records whose headers begin in
    ``[start, end)``; the range at 0 also gives the lines before the file's
    first header (not headed)."""
    if start:
        f.seek(start - 1)
        data, at = b"", start - 1
    else:
        data, at = b"\n", -1     # a header can begin the file
    now = _Record(0, False, fragment_bytes) if start == 0 else None
    while True:
        block = f.read(block_bytes)
        data += block
        done = 0
        for m in HEAD.finditer(data):
            head = at + m.end()
            if now is not None:
                yield from now.add(data[done:m.start()][0 if at + done >= 0 else 1:])
                yield from now.close()
                now = None
            if head >= end:
                return
            now, done = _Record(head, True, fragment_bytes), m.end()
        # what may be the begin of a header that the next block ends stays
        keep = len(data) if not block else max(done, len(data) - HEAD_BYTES)
        if now is not None:
            yield from now.add(data[done:keep][0 if at + done >= 0 else 1:])
        elif at + keep >= end:
            return
        if not block:
            if now is not None:
                yield from now.close()
            return
        at, data = at + keep, data[keep:]


def _open(file: str):
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", file))
    return store, path


class LogTextReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.fragment = int(options.get("fragmentbytes", FRAGMENT_BYTES))

    def partitions(self) -> list[Range]:
        return [Range(f, s, min(s + self.split, n) if not _packed(f) else n) for f, n in self.files
                for s in (range(0, n, self.split) if not _packed(f) else (0,)) if n] or [Range("", 0, 0)]

    def read(self, part: Range):
        import pyarrow as pa
        if not part.file:
            return
        store, path = _open(part.file)
        whole = _packed(part.file)
        with store.open_input_stream(path, compression="detect") if whole else store.open_input_file(path) as f:
            rows, size = [], 0
            for row in records(f, part.start, 1 << 62 if whole else part.end, self.fragment):
                rows.append(row)
                size += len(row[3])
                if size >= BATCH_BYTES:
                    yield _batch(pa, part.file, rows)
                    rows, size = [], 0
            if rows:
                yield _batch(pa, part.file, rows)


def _packed(file: str) -> bool:
    return file.endswith((".gz", ".bz2", ".zst", ".lz4"))


def _batch(pa, file: str, rows: list[tuple]):
    pos, part, headed, text = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(rows)), pa.array(pos, pa.int64()), pa.array(part, pa.int32()), pa.array(headed, pa.bool_()),
         pa.array(text, pa.binary())], names=["file", "pos", "part", "headed", "text"])


class LogTextSource(DataSource):
    """``errorlens_log_text``: the pieces of text logs as in `SCHEMA`."""

    @classmethod
    def name(cls) -> str:
        return "errorlens_log_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogTextReader:
        return LogTextReader(dict(self.options))


def listed_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the files that ``path`` (a file, folder or pattern)
    names, without hidden ones; only names go through the driver."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], list(store.globStatus(where) or [])
    while todo:
        st = todo.pop()
        name = st.getPath().getName()
        if st.isDirectory():
            todo += [s for s in store.listStatus(st.getPath()) if s.getPath().getName()[0] not in "_."]
        elif name[0] not in "_.":
            uri = st.getPath().toUri()
            found.append((f"file://{uri.getPath()}" if uri.getScheme() in (None, "file") else st.getPath().toString(), st.getLen()))
    return sorted(found)


def log_pieces(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES,
               fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame | None:
    """The pieces of the text logs at ``path`` by byte ranges, or None where
    the tasks can't open the store."""
    files = listed_files(spark, path)
    if not all(f.split(":", 1)[0] in OPENED for f, _ in files):
        return None
    spark.dataSource.register(LogTextSource)
    return (spark.read.format("errorlens_log_text").option("files", json.dumps(files))
            .option("splitbytes", str(split_bytes)).option("fragmentbytes", str(fragment_bytes)).load())
