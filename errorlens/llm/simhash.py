"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints that differ in at most ``distance`` bits agree on at least one
of ``distance + 1`` bit bands, so the groups of fingerprints that share a
band's masked pattern are the top nodes of the index. A group that is too
large for a task is split again: two of its fingerprints in reach agree on
one of ``distance + 1`` bands of the bits that vary in the group. Inside a
group the fingerprints stand in the order of their Gray rank; runs of 16
are factored into a node that holds the bits they share, runs of 16 nodes
again. Pairs of nodes whose shared patterns already differ in more than
``distance`` bits are pruned with all that is below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_names, map_arrow, row_hash

FAN = 16
#: A group of more fingerprints is split by further bands.
GROUP_ROWS = 4096
#: Pairs of nodes whose children are compared at once.
FRONTIER = 512


# ------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included. A bit
    is set if it is in over half of the shingle hashes (XXH64, seed 42)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(ends)
    starts = starts.tolist()
    for at in range(0, n, 1 << 16):  # a bounded number of bits at once
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, ``key`` (a hash of the text) and ``fp`` (the fingerprint's
    bits as a long) of every row."""
    def run(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], dtype=np.uint64)
        return {"doc_id": b.column("doc_id"), "key": b.column("key"), "fp": pa.array(fps.view(np.int64))}
    return map_arrow(docs.select("doc_id", "text", text_key().alias("key")), run, "doc_id long, key long, fp long")


def text_key() -> Column:
    return row_hash(F.coalesce(F.col("text"), F.lit("")))


# ------------------------------------------------------- the index in a task

def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def linked_pairs(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of one group within ``distance``."""
    chunks = list(linked_chunks(group, fps, distance))
    return tuple(np.concatenate([c[i] for c in chunks]) if chunks else np.zeros(0, np.int64) for i in (0, 1))


def linked_chunks(group: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of one group within ``distance``, some at a time.
    Rows must be sorted by group and Gray rank. Works over all groups at
    once, from the top nodes of the hierarchy down."""
    levels = [(group, fps, fps)]  # (group, AND, OR) of the nodes of a level
    bounds = []                   # first child of each node
    while True:
        g, ands, ors = levels[-1]
        run_start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        place = np.arange(len(g)) - np.repeat(run_start, np.diff(np.append(run_start, len(g))))
        first = np.flatnonzero(place % FAN == 0)
        if len(first) == len(run_start) and len(levels) > 1:
            break
        levels.append((g[first], np.bitwise_and.reduceat(ands, first), np.bitwise_or.reduceat(ors, first)))
        bounds.append(np.append(first, len(g)))
        if len(levels[-1][0]) == len(run_start):
            break
    # pairs of top nodes: each with itself and, where a group has several, the later ones
    g, ands, ors = levels[-1]
    left, right = [np.arange(len(g))], [np.arange(len(g))]
    for s in range(1, len(g)):
        at = np.flatnonzero(g[s:] == g[:-s])
        if not len(at):
            break
        left.append(at)
        right.append(at + s)
    a, b = np.concatenate(left), np.concatenate(right)
    for level in range(len(levels) - 1, 0, -1):
        below, first = levels[level - 1], bounds[level - 1]
        out_a, out_b = [], []
        for at in range(0, len(a), FRONTIER):
            pa_, pb_ = a[at:at + FRONTIER], b[at:at + FRONTIER]
            na, nb = first[pa_ + 1] - first[pa_], first[pb_ + 1] - first[pb_]
            each = na * nb
            pair = np.repeat(np.arange(len(pa_)), each)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            ca, cb = first[pa_][pair] + k // nb[pair], first[pb_][pair] + k % nb[pair]
            # a node with itself: each pair of children once; leaves not with themselves
            keep = (ca < cb) if level == 1 else (ca <= cb)
            ca, cb = ca[keep], cb[keep]
            _, and_, or_ = below
            shared = ~((and_[ca] ^ or_[ca]) | (and_[cb] ^ or_[cb]))  # bits all of both nodes agree on
            near = np.bitwise_count((and_[ca] ^ and_[cb]) & shared) <= distance
            if level == 1:
                yield ca[near], cb[near]
                continue
            out_a.append(ca[near])
            out_b.append(cb[near])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)


def stars(n: int, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place each of ``n`` places is connected with."""
    root = np.arange(n)
    for a, b in chunks:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (root[root] != root).any():
                root = root[root]
    return root


# ------------------------------------------------------------ the whole table

def split_bits(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` bands that cover the given bit places."""
    return [sum(1 << int(b) for b in band) for band in np.array_split(np.array(bits), parts) if len(band)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _banded(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (fp) for each of the masks: mask and the masked pattern."""
    each = F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in masks])).alias("mask")
    return rows.select("fp", each).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def _group_links(rows: DataFrame, distance: int) -> DataFrame:
    """Star links (fp, root) inside each group (mask, pattern) of ``rows``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def links(part: np.ndarray) -> pa.RecordBatch:
            fps = part[:, 2].view(np.uint64)
            change = np.any(part[1:, :2] != part[:-1, :2], axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            order = np.lexsort((gray_rank(fps), group))
            group, fps = group[order], np.ascontiguousarray(fps[order])
            root = stars(len(fps), linked_chunks(group, fps, distance))
            # the centre of a star is its smallest fingerprint, the same in every band
            out = fps.view(np.int64)
            least = out.copy()
            np.minimum.at(least, root, out)
            least = least[root]
            own = np.flatnonzero(least != out)
            return pa.RecordBatch.from_arrays([pa.array(out[own]), pa.array(least[own])], names=["a", "b"])

        for batch in batches:
            part = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("mask", "pattern", "fp")], axis=1)
            if held is not None:
                part = np.concatenate([held, part])
            if not len(part):
                continue
            # the last group may go on in the next batch
            last = np.flatnonzero(np.any(part != 0, axis=1) | True)[-1]
            same = np.all(part[:, :2] == part[last, :2], axis=1)
            cut = len(part) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield links(part[:cut])
            held = part[cut:]
        if held is not None and len(held):
            yield links(held)

    # by a hash of the group: a shuffle by its columns alone would be left out after a join by them, and if that join
    # then becomes a broadcast at run time, the groups come torn
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("mask", "pattern"))
    return spread.sortWithinPartitions("mask", "pattern").select("mask", "pattern", "fp").mapInArrow(run, "a long, b long")


def _bands_of(large: DataFrame, parts: int) -> DataFrame:
    """``large`` (mask, pattern, varying) with ``masks``: the bits that all
    fingerprints of the group share, joined with each of ``parts`` bands of
    the bits that vary in it."""
    def run(b: pa.RecordBatch) -> dict:
        masks = []
        for v in b.column("varying").to_pylist():
            bits = [k for k in range(64) if v >> k & 1]
            masks.append([signed((~v | m) % (1 << 64)) for m in split_bits(bits, parts)])
        return {"mask": b.column("mask"), "pattern": b.column("pattern"), "masks": pa.array(masks, pa.list_(pa.int64()))}
    return map_arrow(large.select("mask", "pattern", "varying"), run, "mask long, pattern long, masks array<bigint>")


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp)
    within ``distance`` bits, directly or in steps inside a group. No two
    linked fingerprints are lost; not every pair is listed.

    A group of over `GROUP_ROWS` fingerprints is split by bands of the bits
    that vary in it, which also splits a dense cluster whose fingerprints
    share most bits; each split takes a band from the varying bits, so a
    few rounds end it."""
    parts = distance + 1
    level = _banded(distinct, split_bits(list(range(64)), parts))
    out = None
    while True:
        sizes = checkpoint(level.groupBy("mask", "pattern").agg(
            F.count(F.lit(1)).alias("_n"), F.bit_and("fp").bitwiseXOR(F.bit_or("fp")).alias("varying")).where("_n > 1"))
        large = sizes.where(F.col("_n") > GROUP_ROWS)
        small = sizes.where(F.col("_n") <= GROUP_ROWS).select("mask", "pattern")
        found = _group_links(level.join(small, ["mask", "pattern"]), distance)
        out = found if out is None else out.unionByName(found)
        if not large.limit(1).count():
            return out
        split = checkpoint(_bands_of(large, parts))
        rows = level.join(split, ["mask", "pattern"]).select("fp", F.explode_outer("masks").alias("mask"))
        level = checkpoint(rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): root is
    the smallest node it is connected with. Large-star and small-star rounds
    (each node links its larger, then its smaller neighbours to the smallest)
    until nothing changes; edges stay distributed, the driver sees a count."""
    def seen(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = seen(now)
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpoint(large.where("a <> b"))
        low = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        small = (large.join(low.withColumnRenamed("u", "a"), "a")
                 .select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")),
                                           F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
                 .select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct())
        now, before = checkpoint(small), state
        state = seen(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(docs: DataFrame, words: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, fp) of every row, and (fp, least, root) of every
    fingerprint: its smallest (id, key) and the root of its component."""
    rows = checkpoint(fingerprints(docs, words))
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = checkpoint(rows.groupBy("fp").agg(F.min(at).alias("least")))
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rows, checkpoint(rooted)


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of
    ``docs``: the smallest doc_id that a chain of fingerprints, each within
    ``distance`` bits of the next, reaches.

    Null, empty and wordless texts have the fingerprint zero and are linked
    like any other; repeated rows share a component; a component whose ids
    are all null has a null component_id. Columns besides doc_id and text
    are ignored; an empty table gives an empty result. Equal fingerprints
    are one node with their smallest doc_id, so a group of copies of any
    size costs one row."""
    rows, rooted = _rooted(docs, words, distance)
    least = checkpoint(rooted.groupBy("root").agg(F.min("least").alias("_first")))
    named = checkpoint(rooted.select(F.col("fp").alias("_fp"), "root").join(least, "root")
                       .select("_fp", F.col("_first.doc_id").alias("component_id")))
    return rows.join(named, rows["fp"] == named["_fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their
    columns, whatever their names: of each the one with the smallest doc_id
    (rows without an id last, ties by text hash). Of rows equal in id and text
    one stays. Null, empty and wordless texts are one component with all that
    is near the fingerprint zero; very long texts are read whole; an empty
    table gives an empty one."""
    rows, rooted = _rooted(docs, words, distance)
    h, doc, key = free_names(docs, "h", "id", "key")
    keep = rooted.groupBy("root").agg(F.min("least").alias("_first")).select(
        F.col("_first.doc_id").alias(doc), F.col("_first.key").alias(key))
    keep = checkpoint(keep)
    chosen = (F.col(h) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc))
    kept = docs.withColumn(h, text_key()).join(keep, chosen, "left_semi")
    # rows repeat only in tables that hold whole copies of rows
    if rows.count() != rows.select("doc_id", "key").distinct().count():
        kept = kept.dropDuplicates(["doc_id", h])
    return kept.drop(h)
