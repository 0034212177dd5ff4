"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errorlens.session import checkpoint, ensure_checkpoint_dir

__all__ = ["checkpoint", "ensure_checkpoint_dir", "table", "row_hash", "Ranked", "ranked", "map_arrow",
           "utf8", "shuffle_partitions", "free_names", "own"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_hash(*cols: str | Column) -> Column:
    """64-bit hash of the columns; tells rows apart that share an id."""
    return F.xxhash64(*cols)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` has not, for helper columns beside its own."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any(f"_{s}{tail}".lower() in taken for s in stems):
        tail += "_"
    return [f"_{s}{tail}" for s in stems]


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the ``n + 1`` offsets of its
    rows, without a copy of the bytes. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, ends


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch that returns the output
    columns by name, in the order of ``schema``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x)
                                                  for x in out.values()], names=list(out))
    return df.mapInArrow(run, schema)


class Ranked:
    """A table in one global order, held range-partitioned and sorted in the
    checkpoint folder, with the totals of each partition (the only thing the
    driver sees: one row per partition)."""

    def __init__(self, rows: DataFrame, totals: dict[int, tuple[int, int]], size: str):
        self.rows, self.size = rows, size
        self.before: dict[int, tuple[int, int]] = {}
        total = count = 0
        for pid in sorted(totals):
            self.before[pid] = (total, count)
            total, count = total + totals[pid][0], count + totals[pid][1]
        self.total, self.count = total, count

    def _numbered(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        before, size = self.before, self.size
        names = [c for c in self.rows.columns if c != "_pid"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if at is None:
                    at = list(before[batch.column("_pid")[0].as_py()])
                sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in names]
                    + [pa.array(ends - sizes + at[0]), pa.array(np.arange(len(sizes), dtype=np.int64) + at[1])],
                    names=[*names, "_prefix", "_index"])
                at = [at[0] + int(ends[-1]), at[1] + len(sizes)]

        return run

    def frame(self) -> DataFrame:
        """The rows with ``_prefix`` (sum of the sizes before the row in the
        global order) and ``_index`` (its number from 0). No shuffle: each
        task adds up its own sorted partition from that partition's start."""
        kept = self.rows.drop("_pid")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        return self.rows.mapInArrow(self._numbered(), f"{fields}, _prefix long, _index long")

    def mapped(self, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``frame().mapInArrow(fn, schema)`` in one Python worker a task; one
        mapInArrow after the other keeps a worker and its batches for each."""
        numbered = self._numbered()
        return self.rows.mapInArrow(lambda batches: fn(numbered(batches)), schema)


def ranked(df: DataFrame, order: Sequence[Column], size: str) -> Ranked:
    """Put narrow rows into one global order and prepare running sums.

    Range partitioning spreads any key, a hot one too: the row number that
    ends the sort key makes every row distinct. ``size`` is a non-null long
    column. Ties keep one order within a run; rows that tie in all of
    ``order`` are interchangeable for the callers."""
    parts = shuffle_partitions(df.sparkSession)
    narrow = checkpoint(df.withColumn("_uid", F.monotonically_increasing_id()))
    keys = [*order, F.col("_uid")]
    rows = checkpoint(narrow.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                      .drop("_uid").withColumn("_pid", F.spark_partition_id()))
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy("_pid").agg(F.sum(size), F.count(F.lit(1))).collect()}
    return Ranked(rows, totals, size)
