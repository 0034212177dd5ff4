"""Benchmark decontamination over a distributed positional inverted index.

DataFrame operations only. The test texts are cut into windows of words.
Of each window the term that is rarest in the training corpus is its
anchor; the index stores the postings of the anchor terms, (term, document,
position), each with the words around the position, i.e. the offset-adjusted
part of the other terms' lists that can meet it. A phrase query joins the
postings of a window's anchor with the window and intersects term by term,
from the rarest on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpoint, free_names, row_hash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term that ends every text: its position is the number of words.
END = ""
#: Bytes of test terms up to which they may be broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a text (A-Z lower-cased) in order, then the empty term
    `END`. Null text has no words."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    # between a word and a separator: nothing but the end gives an empty term
    return F.slice(F.split(F.concat(F.lit("a "), low, F.lit(" ")), SEPARATOR), 2, 1 << 30)


def windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(item_id as text, at, words) of every window of ``n`` consecutive
    words of an item; an item of fewer words, but not none, is one window.
    Null ids read as the text null; repeated windows of an item are one."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
                             words(F.col("text")).alias("_w"))
    items = items.select("item_id", F.expr("slice(_w, 1, size(_w) - 1)").alias("_w")).where("size(_w) > 0")
    return (items.select("item_id", "_w", F.explode(F.expr(f"sequence(0, greatest(size(_w) - {n}, 0))")).alias("at"))
            .select("item_id", F.expr(f"slice(_w, at + 1, {n})").alias("words")).distinct())


def bounded(df: DataFrame, size: Column) -> DataFrame:
    """``df`` marked for broadcast if its measured bytes are within
    `BROADCAST_BYTES`; beyond, Spark joins it by shuffle."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all ``docs`` of each of ``terms``."""
    tokens = docs.select(F.explode_outer(words(F.col("text"))).alias("term"))
    small = bounded(terms, F.octet_length("term") + 32)
    found = tokens.join(small, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchored(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """``wins`` with ``ranked``: the places of its words (from 0) from the
    rarest to the most frequent. The first is the anchor."""
    keyed = wins.withColumn("_key", F.monotonically_increasing_id())
    keyed = checkpoint(keyed)
    each = keyed.select("_key", F.posexplode("words").alias("at", "term")).join(counts, "term")
    ranks = each.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("n", "at"))).alias("_r"))
    return (keyed.join(ranks, "_key")
            .select("item_id", "words", F.col("_r.at").alias("ranked"),
                    F.expr("words[_r[0].at]").alias("term"), F.expr("_r[0].at").alias("offset")))


def build_index(docs: DataFrame, terms: DataFrame, reach: int = 12) -> DataFrame:
    """The stored index: (doc_id, key, term, pos, around) for every position
    of ``terms`` (column term) in ``docs``, and a row of the term `END` for
    each document, at the number of its words. ``around`` holds the words
    from ``pos - reach`` to ``pos + reach``, with nulls beyond the text.
    ``key`` is a hash of the text: with doc_id it tells rows apart.

    Postings are written where the documents lie; nothing is shuffled, so a
    term that stands in every document makes no hot task."""
    all_terms = checkpoint(terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct())
    held = docs.select("doc_id", row_hash(F.coalesce(F.col("text"), F.lit(""))).alias("key"),
                       words(F.col("text")).alias("w"))
    posted = held.select("doc_id", "key", "w", F.posexplode_outer("w").alias("pos", "term"))
    met = posted.join(bounded(all_terms, F.octet_length("term") + 32), "term")
    around = F.expr(
        f"CASE WHEN term = '' THEN NULL ELSE concat(array_repeat(cast(null as string), greatest({reach} - pos, 0)), "
        f"slice(w, greatest(pos - {reach}, 0) + 1, least(pos, {reach}) + 1 + {reach})) END")
    return checkpoint(met.select("doc_id", "key", "term", "pos", around.alias("around")))


def phrase_matches(index: DataFrame, wins: DataFrame, reach: int = 12) -> DataFrame:
    """(doc_id, key, item_id, start, length) of every exact occurrence of a
    window. The postings of the anchor are intersected with the lists of the
    window's other terms, the rarest first: a term must stand at its offset
    from the anchor, or the candidate ends there."""
    # F.forall stops at the first term that misses
    every = F.expr(f"forall(ranked, r -> get(around, {reach} + r - offset) <=> words[r])")
    return (index.where(F.col("term") != END).join(bounded(wins, F.size("words") * 24 + 64), "term").where(every)
            .select("doc_id", "key", "item_id", (F.col("pos") - F.col("offset")).alias("start"),
                    F.size("words").alias("length")))


def proximity_matches(index: DataFrame, wins: DataFrame, terms: int = 4, reach: int = 12) -> DataFrame:
    """(doc_id, key, item_id, pos) where the ``terms`` rarest terms of a
    window stand within ``reach`` words of its anchor, in any order."""
    near = F.expr(f"forall(slice(ranked, 1, {terms}), r -> array_contains(around, words[r]))")
    return (index.where(F.col("term") != END).join(bounded(wins, F.size("words") * 24 + 64), "term").where(near)
            .select("doc_id", "key", "item_id", "pos").distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and
    n_near (items with a proximity match) of every row of ``docs``.

    A word is hit if it lies in an occurrence of a window of an item.
    Contaminated: some hit, and ``share`` times the hits reach the words.
    Null and wordless texts have no hits; equal rows get equal results; null
    ids are kept; an empty benchmark hits nothing. Other columns are
    ignored."""
    docs = docs.select("doc_id", "text")
    wins = checkpoint(windows(benchmark, n))
    terms = checkpoint(wins.select(F.explode("words").alias("term")).distinct())
    with_anchor = checkpoint(anchored(wins, checkpoint(term_counts(docs, terms))))
    index = build_index(docs, with_anchor.select("term"), n - 1)
    doc = ["doc_id", "key"]

    hits = checkpoint(phrase_matches(index, with_anchor, n - 1).distinct())
    runs = hits.groupBy(*doc, "start").agg(F.max("length").alias("length"))
    earlier = Window.partitionBy(*doc).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = (runs.withColumn("_from", F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0))))
               .groupBy(*doc).agg(F.sum(F.greatest(end - F.col("_from"), F.lit(0))).alias("n_hit")))
    items = hits.groupBy(*doc).agg(F.collect_set("item_id").alias("_items"))
    near = (proximity_matches(index, with_anchor, 4, n - 1).groupBy(*doc)
            .agg(F.countDistinct("item_id").alias("n_near")))
    found = checkpoint(covered.join(items, doc_key(covered, items)).drop(items["doc_id"]).drop(items["key"]))
    sized = index.where(F.col("term") == END).select("doc_id", "key", F.col("pos").cast("long").alias("n_words"))
    out = _left(_left(sized, found), checkpoint(near))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = out.select("doc_id", "key", "n_words", count("n_hit").alias("n_hit"), count("n_near").alias("n_near"),
                     F.sort_array(F.coalesce("_items", F.array().cast("array<string>"))).alias("_items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near", "key")


def doc_key(a: DataFrame, b: DataFrame) -> Column:
    return (a["key"] == b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _left(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    return a.join(other, (a["key"] == other["_key"]) & a["doc_id"].eqNullSafe(other["_doc"]), "left").drop("_doc", "_key")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns,
    whatever their names.

    Null, empty and wordless texts stay; null ids are kept; rows equal in id
    and text stay or go together; very long texts are judged whole; an empty
    table gives an empty one, an empty benchmark keeps all."""
    h, key, doc = free_names(docs, "h", "key", "doc")
    bad = checkpoint(contamination(docs, benchmark).where("contaminated")
                     .select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct())
    keyed = docs.withColumn(h, row_hash(F.coalesce(F.col("text"), F.lit(""))))
    return keyed.join(bad, (F.col(h) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti").drop(h)
