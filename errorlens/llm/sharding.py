"""Sharding: minimax contiguous partition.

Rows stand in one order, in atomic groups: rows of equal text, or each row by
itself. The smallest feasible shard capacity over the ordered group sizes is
found by binary search, each capacity checked greedily, and the order is cut
there. The capacity is exact at any size: the places where a cut can be are
looked up ever more finely.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Ranked, checkpoint, free_names, ranked, shuffle_partitions


def greedy_cuts(ends: np.ndarray, capacity: int, n: int) -> list[int] | None:
    """Fill shards from the left, each up to ``capacity``; the group number
    after each of the ``n`` shards, or None if the groups don't fit.
    ``ends`` are the inclusive prefix sums of the group sizes."""
    cuts, at = [], 0
    for _ in range(n):
        filled = int(ends[at - 1]) if at else 0
        at = int(np.searchsorted(ends, filled + capacity, side="right"))
        cuts.append(at)
    return cuts if at == len(ends) else None


def minimax_cuts(sizes: Sequence[int], n: int) -> tuple[int, list[int]]:
    """The smallest capacity ``n`` contiguous shards need, and ``n - 1`` cuts
    (numbers of the first group of shards 1 to n - 1) that keep it.

    Greedy filling from the left gives the latest place of every cut, from
    the right the earliest; between them each cut is put nearest to its
    equal share, so that the slack isn't all left to the last shard."""
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    if not len(ends):
        return 0, [0] * (n - 1)
    total = int(ends[-1])
    low, high = max(int(max(sizes)), ceil(total / n)), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy_cuts(ends, mid, n) else (mid + 1, high)
    from_right = greedy_cuts(np.cumsum(np.asarray(sizes, dtype=np.int64)[::-1]), low, n)
    earliest = [len(ends) - c for c in from_right[:-1]][::-1]
    cuts, at = [], 0
    for k in range(1, n):
        filled = int(ends[at - 1]) if at else 0
        last = int(np.searchsorted(ends, filled + low, side="right"))
        share = total * k / n
        near = int(np.searchsorted(ends, share, side="left"))
        # the group that crosses the share goes to the nearer side
        if near < len(ends) and ends[near] - share <= share - (ends[near - 1] if near else 0):
            near += 1
        at = max(at, earliest[k - 1], min(last, near))
        cuts.append(at)
    return low, cuts


def group_starts(order_of: Ranked, first: str, group: str) -> DataFrame:
    """_prefix and _index of the first row of each group, of rows ordered by
    (``first``, ``group``, ...). A group may go over several partitions; the
    driver sees the last group of each partition."""
    last = {r[0]: r[1] for r in order_of.rows.groupBy("_pid")
            .agg(F.max(F.struct(first, group))[group]).collect()}
    before, previous = {}, None
    for pid in sorted(last):
        before[order_of.before[pid][1]] = previous
        previous = last[pid]

    def run(batches):
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            index, keys = batch.column("_index"), batch.column(group).to_pylist()
            if key is None:
                key = before[index[0].as_py()]
            new = np.array([a != b for a, b in zip(keys, [key, *keys])], dtype=bool)
            key = keys[-1]
            yield pa.RecordBatch.from_arrays([batch.column("_prefix").filter(pa.array(new)), index.filter(pa.array(new))],
                                             names=["_prefix", "_index"])

    return order_of.mapped(run, "_prefix long, _index long")


def possible_cuts(edges: np.ndarray, whole: np.ndarray, total: int, low: int, high: int, n: int) -> np.ndarray:
    """For each gap after one of ``edges``, whether a cut of the greedy filling
    by a capacity from ``low`` to ``high`` can be inside it; a gap that is
    ``whole`` has no place for one."""
    ends, out = np.append(edges[1:], total), np.zeros(len(edges), bool)
    first = last = 0
    for _ in range(n - 1):
        first = int(edges[np.searchsorted(edges, first + low, side="right") - 1])
        last = min(last + high, total)
        at = int(np.searchsorted(edges, last, side="right")) - 1
        if whole[at] and last < total:
            last = int(edges[at])
        out |= (edges < last) & (ends > first)
    return out & ~whole


def exact_cuts(starts: DataFrame, total: int, n: int, steps: int) -> tuple[int, list[tuple[int, int]]]:
    """The smallest capacity, and the running size and row number at its
    ``n - 1`` cuts. ``starts``: _prefix and _index of every group's first row.

    Over some of the starts the smallest capacity is too large by less than
    the widest gap between two of them, so it is known within a gap and each
    cut within a few; the next round looks into those gaps only, until none
    is left. The driver sees the first and last start of some ``steps``
    steps a round, the finer the nearer the bounds are; a round halves the
    step at least."""
    edges, rows, whole = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
    wanted, unit, low = np.ones(1, bool), total + 1, ceil(total / n)
    while True:
        gaps = np.append(edges[1:], total + 1) - edges
        unit = max(1, min(ceil(int(gaps[wanted].sum()) / steps), unit // 2))
        sent = (edges, wanted, unit)

        def run(batches, sent=sent):
            known, asked, width = sent
            for batch in batches:
                prefix = batch.column("_prefix").to_numpy()
                gap = np.searchsorted(known, prefix, side="right") - 1
                keep = pa.array(asked[gap])
                step = (prefix - known[gap]) // width
                yield pa.RecordBatch.from_arrays(
                    [x.filter(keep) for x in (pa.array(gap), pa.array(step), batch.column("_prefix"), batch.column("_index"))],
                    names=["gap", "step", "_prefix", "_index"])

        got = (starts.mapInArrow(run, "gap long, step long, _prefix long, _index long").groupBy("gap", "step")
               .agg(F.min(F.struct("_prefix", "_index")), F.max(F.struct("_prefix", -F.col("_index"))),
                    F.count(F.lit(1))).collect())
        found = {int(e): (int(r), bool(w)) for e, r, w, x in zip(edges, rows, whole, wanted) if not x}
        for _, _, least, most, count in got:
            found[most[0]] = (-most[1], True)
            # no start between the first and the last of a step
            found[least[0]] = (least[1], least[0] == most[0] or count == 2 or unit <= 2)
        if not found:
            return 0, [(0, 0)] * (n - 1)
        edges = np.array(sorted(found), dtype=np.int64)
        rows, whole = (np.array([found[int(e)][k] for e in edges]) for k in (0, 1))
        sizes = np.diff(np.append(edges, total))
        high, cuts = minimax_cuts(sizes, n)
        # gaps that were asked for and are not whole are a step wide at most
        open_gaps = sizes[~whole & (sizes < unit)]
        low = max(low, high - int(open_gaps.max(initial=0)), int(sizes[whole].max(initial=0)))
        wanted = possible_cuts(edges, whole, total, low, high, n)
        if low >= high or not wanted.any():
            return high, [(int(edges[c]), int(rows[c])) if c < len(edges) else (total + 1, 0) for c in cuts]


def minimax_shards(docs: DataFrame, n_shards: int, order: Sequence[Column], size: str,
                   resolution: int = 1000, group: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` (narrow rows with the long column ``size``) with ``shard``
    and ``slot`` (place in the shard, gapless from 0).

    An atomic group is a row, or with ``group`` (two columns that ``order``
    begins with, the second a non-null key with one value of the first) the
    rows of a key; their sizes are positive then. The largest shard is as
    small as contiguous shards of whole groups can be. The driver sees
    some ``n_shards * resolution`` places at a time.

    Null sizes count as 0, null order keys go first, equal rows keep any
    order among themselves. An empty table gives an empty result."""
    order_of = ranked(docs.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long")), order, size)
    # two numbers a group, read again in every round
    starts = checkpoint(group_starts(order_of, *group) if group else order_of.frame().select("_prefix", "_index"))
    _, cuts = exact_cuts(starts, order_of.total, n_shards, n_shards * resolution)
    edges = np.array([c[0] for c in cuts], dtype=np.int64)
    first = np.array([0, *(c[1] for c in cuts)], dtype=np.int64)
    names = [c for c in docs.columns if c not in ("shard", "slot")]

    def place(batches):
        for batch in batches:
            shard = np.searchsorted(edges, batch.column("_prefix").to_numpy(), side="right")
            slot = batch.column("_index").to_numpy() - first[shard]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names]
                                             + [pa.array(shard.astype(np.int32)), pa.array(slot)],
                                             names=[*names, "shard", "slot"])

    fields = ", ".join(f"`{c}` {order_of.rows.schema[c].dataType.simpleString()}" for c in names)
    return order_of.mapped(place, f"{fields}, shard int, slot long")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("_text"))


def _shard_map(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def shard_map(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row
    of ``docs``, by the law ``bytes``: sizes near equal. Each row is a group;
    see `text_shard_map` for equal texts in one shard.

    Rows go in the order of doc_id (null first). A null text has size 16
    and the checksum of no bytes, 0. Other columns are ignored."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32")]
    return _shard_map(minimax_shards(_narrow(docs).drop("_text"), n_shards, order, "size"))


def text_shard_map(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """As `shard_map`, with the rows of equal texts as one group, which goes
    to one shard whole (null is as empty). Groups go in the order of their
    smallest doc_id (null first), rows of a group in that of doc_id. A group
    larger than a share of the total makes its shard as large."""
    return _shard_map(_placed_by_text(docs, n_shards))


def _placed_by_text(docs: DataFrame, n_shards: int) -> DataFrame:
    rows = checkpoint(_narrow(docs))
    spark = docs.sparkSession
    groups = checkpoint(rows.groupBy("_text").agg(F.min(F.struct("doc_id"))["doc_id"].alias("_first"),
                                                  F.count(F.lit(1)).alias("_copies"))
                        .where("_copies > 1").withColumnRenamed("_text", "_key"))
    # a group with over a share of the rows is broadcast; there are few of them
    share = ceil(rows.count() / (4 * shuffle_partitions(spark)))
    large = groups.where(F.col("_copies") > share).withColumn("_large", F.lit(True))
    met = rows.join(F.broadcast(large), F.col("_text") == F.col("_key"), "left")
    names = ["doc_id", "size", "text_crc32", "_text", "_first"]
    one = met.where("_large").select(*names)
    rest = (met.where("_large is null").select("doc_id", "size", "text_crc32", "_text")
            .join(groups.where(F.col("_copies") <= share), F.col("_text") == F.col("_key"), "left")
            .withColumn("_first", F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("_first"))).select(*names))
    order = [F.col("_first").asc_nulls_first(), F.col("_text"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32")]
    return minimax_shards(one.unionByName(rest), n_shards, order, "size", group=("_first", "_text"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Write the rows of ``docs`` into ``shard=N`` folders by `text_shard_map`,
    in slot order inside a file, with their columns and ``slot`` (columns of
    these two names are replaced).

    Rows meet their places by doc_id and the SHA-256 of the text. Rows equal in
    both are interchangeable and stand one after the other in one shard, so
    their places are a first slot and the row's number among them, and every
    row is written once. Null text is as empty, null ids are matched like
    others; an empty table writes no shard."""
    h, first, to, slot = free_names(docs, "h", "first", "shard", "slot")
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    of_id = F.encode(F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), "UTF-8")
    places = (_placed_by_text(docs, n_shards).groupBy(F.concat("_text", of_id).alias(first))
              .agg(F.min("shard").alias(to), F.min("slot").alias(slot)))
    met = docs.drop("shard", "slot").withColumn(h, F.concat(sha, of_id)).join(places, F.col(h) == F.col(first))
    # dealt by the key already: the numbers cost no exchange
    number = F.row_number().over(Window.partitionBy(h).orderBy(F.lit(0)))
    out = met.withColumns({"shard": F.col(to), "slot": F.col(slot) + number - 1}).drop(h, first, to, slot)
    (out.repartitionByRange(shuffle_partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
