"""Mixing sources to target weights: Efraimidis-Spirakis sampling.

Each source gets a token target. Whole epochs of the source come first; the
rest of the target is a sample without replacement: every document draws an
exponential key divided by its quality weight, the source is sorted by the
keys, and running sums of the sizes say where the budget ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_names, map_arrow, own, ranked, row_hash

LETTERS = bytes(c for c in range(256) if chr(c).isalpha() and c < 128 or c >= 128 or c in b" \t\n\r\x0b\x0c")


def text_stats(batch: pa.RecordBatch) -> dict:
    """Words, and a quality weight: the share of the text's bytes that are
    letters or white space, squared, 0.05 at least. Symbol soup, tables and
    markup remnants are drawn later than prose."""
    size, weight = [], []
    for t in batch.column("text").to_pylist():
        raw = (t or "").encode("utf-8", "surrogatepass")
        size.append(len(raw.split()))
        odd = len(raw.translate(None, LETTERS))
        weight.append(max(0.05, (1 - odd / len(raw)) ** 2) if raw else 0.05)
    return {**{c: batch.column(c) for c in ("doc_id", "source", "_draw")},
            "size": pa.array(size, pa.int64()), "weight": pa.array(weight, pa.float64())}


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float) -> list[float]:
    """Split ``total`` by weight; a part that would pass ``limit`` times its
    size stops there and the excess is shared again by weight among the
    rest, until none is above."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > limit * sizes[i]]
        if not full:
            for i in open_:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = limit * sizes[i]
            left -= out[i]
        done = set(full)
        open_ = [i for i in open_ if i not in done]
    return out


def source_targets(stats: DataFrame, cycle: Sequence[float], ratio: float, limit: float) -> DataFrame:
    """source, source_size, target and start (sizes of all sources before it,
    in code point order, null last) of every source of ``stats``; any number
    of sources. `share_out` as a table: a round tells from the level of the
    last one which sources are full, and adds up what they hold and the
    weights of the others; the level only rises, until no more are full."""
    order_of = ranked(stats.groupBy("source").agg(F.sum("size").alias("source_size")),
                      [F.col("source").asc_nulls_last()], "source_size")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    table = checkpoint(order_of.frame().select(
        "source", "source_size", F.col("_prefix").alias("start"),
        F.element_at(weights, (F.col("_index") % len(cycle) + 1).cast("int")).alias("_w")))
    most = F.lit(float(limit)) * F.col("source_size")
    level, full = F.lit(0.0), -1
    while True:
        over = most < level * F.col("_w")
        held, open_, n = table.agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)),
                                   F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0)),
                                   F.count_if(over)).first()
        if n == full or not open_:
            return table.select("source", "source_size", "start", F.when(over, most).otherwise(level * F.col("_w")).alias("target"))
        full, level = n, F.lit((ratio * order_of.total - limit * held) / open_)


def mix(docs: DataFrame, cycle: Sequence[float] = (5, 2, 1), ratio: float = 1.5, limit: float = 2.0,
        seed: int = 7) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it: doc_id, source,
    size (words; null text 0), weight, source_size, target (of its source),
    epochs (whole passes over its source), draw_key, copies (rows to write)
    and taken (words, repeats counted).

    Sources in code point order, null last, have the weights of ``cycle``,
    repeating, and share ``ratio`` times all words. Of the document on which
    a source's budget ends, the first words up to the budget are counted, so
    a source takes its target to the word; the row itself is written whole.
    Draws depend on id, text and seed only, so reruns agree; equal rows draw
    the same key and stand next to each other. A document without words
    takes 0. A source without words has target 0. Very long texts count
    whole. Other columns than doc_id, text and source are ignored; an empty
    table gives an empty result."""
    draw = row_hash(F.lit(seed), "doc_id", "text")
    stats = checkpoint(map_arrow(docs.select("doc_id", "source", "text", draw.alias("_draw")), text_stats,
                                 "doc_id long, source string, _draw long, size long, weight double"))
    sources = source_targets(stats, cycle, ratio, limit)

    unit = (F.col("_draw").bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = stats.withColumn("draw_key", -F.log(unit) / F.col("weight"))
    rows = ranked(keyed, [F.col("source").asc_nulls_last(), F.col("draw_key"), F.col("doc_id").asc_nulls_first()],
                  "size").frame()
    met = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    met = met.withColumn("epochs", whole).withColumn("_before", F.col("_prefix") - F.col("start"))
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size")
    met = met.withColumn("_rest", rest)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_rest") - F.col("_before"), F.col("size")))
    return met.select("doc_id", "source", "size", "weight", "source_size", "target", "epochs", "draw_key",
                      (F.col("epochs") + (F.col("_before") < F.col("_rest")).cast("long")).alias("copies"),
                      (F.col("epochs") * F.col("size") + part).alias("taken"), "_draw")


def mixed_rows(docs: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken
    (``copies`` of ``plan``, the result of `mix` with the same seed), with
    the columns of ``docs``, whatever their names. Equal rows are one row of
    the join and written as often as all of them together are taken. Null ids
    and texts are values like others; an empty table gives an empty one."""
    draw, key, doc, n, rows, copy = free_names(docs, "draw", "key", "id", "n", "rows", "copy")
    want = (plan.groupBy("_draw", "doc_id").agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(rows))
            .where(F.col(n) > 0).withColumnRenamed("doc_id", doc).withColumnRenamed("_draw", key))
    keyed = docs.withColumn(draw, row_hash(F.lit(seed), "doc_id", "text"))
    out = keyed.join(want, (F.col(draw) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc)))
    # of r equal rows taken n times in all, row k is written n // r or n // r + 1 times
    base, more = F.floor(F.col(n) / F.col(rows)), F.col(n) % F.col(rows)
    alone = F.sequence(F.lit(1), F.when(F.col(rows) == 1, F.col(n)).otherwise(base + (more > 0).cast("long")))
    return out.withColumn(copy, F.explode(alone)).select(*own(docs))
