"""Message similarity (F8, F9), similar pairs (J8) and cluster merge (M1).

The reference merges greedily: in rank order, each cluster not yet merged
absorbs every later unmerged cluster related to it. A cluster is a leader
exactly when no earlier-ranked leader is related to it, and a non-leader
joins its earliest related leader, so the leaders are the lexicographically
first maximal independent set of the relation graph. That set is computed
here in rounds: an undecided cluster with no undecided earlier neighbour
becomes a leader, its undecided neighbours are absorbed, repeat.

The relation is never expanded into cluster pairs. It is a union of
groups: clusters with the same exception class and template (related to
each other and, as a whole, to every group whose template is similar), and
clusters with the same known location. Every round works on per-group
minima, so a group of a million identical clusters costs one aggregate
row, not a million squared pairs. Only distinct templates are compared,
blocked by exception class and by length band (lengths within a factor 0.7
fall in the same or adjacent band), and ``levenshtein`` stops early at the
largest distance that can still pass.

Deviation, documented: the reference lets a leader without a location take
one from a cluster it absorbs and then relate by that location later in the
same pass; here relations use the locations as the scan produced them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorlens.functions._util import as_col
from errorlens.functions.templates import normalize_message
from errorlens.operators.clusters import severity
from errorlens.session import checkpoint

THRESHOLD = 0.7


def similarity(a, b) -> Column:
    """F8: ``1 - levenshtein / max length``; 0 when either is null, 1 when
    equal (two empty texts included)."""
    x, y = as_col(a), as_col(b)
    m = F.greatest(F.length(x), F.length(y))
    sim = F.lit(1.0) - F.levenshtein(x, y).cast("double") / m.cast("double")
    return (F.when(x.isNull() | y.isNull(), F.lit(0.0))
            .when(x == y, F.lit(1.0)).otherwise(sim))


def messages_similar(a, b, mode: str = "core", threshold: float = THRESHOLD) -> Column:
    """both templated, similarity at least ``threshold``."""
    return similarity(normalize_message(a, mode), normalize_message(b, mode)) >= threshold


def _band(length: Column, threshold: float) -> Column:
    # lengths la <= lb with la >= threshold * lb differ by at most one band
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) /
                   F.lit(math.log(1.0 / threshold))).cast("int")


#: Longs of a template's character-pair bitmap.
BITMAP = 8


def _pair_bits(text: Column) -> list[Column]:
    """The pairs of neighbouring characters of ``text``, hashed into a bitmap
    of ``BITMAP`` longs."""
    at = F.when(F.length(text) >= 2, F.transform(
        F.sequence(F.lit(1), F.length(text) - 1),
        lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(2))), F.lit(64 * BITMAP)).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    one = F.lit(1).cast("bigint")

    def word(k: int) -> Column:
        mine = F.filter(at, lambda b: F.floor(b / 64) == k)
        return F.aggregate(mine, F.lit(0).cast("bigint"),
                           lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, F.pmod(b, F.lit(64)))))
    return [word(k).alias(f"bits{k}") for k in range(BITMAP)]


def _bits_apart(x: str, y: str) -> Column:
    """Bits of ``x`` that ``y`` has not."""
    each = [F.bit_count(F.col(f"{x}_bits{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}_bits{k}")))) for k in range(BITMAP)]
    return sum(each[1:], each[0])


def similar_template_pairs(keys: DataFrame, threshold: float = THRESHOLD,
                           block_rows: int = 500) -> DataFrame:
    """J8 (template rule) over distinct ``(exception_class, template)`` keys:
    pairs of different templates of the same exception class (null equal
    to null) with similarity at least ``threshold``. Both directions.

    Candidates meet by an equi-join on (class, length band), a band with the
    next one up. A block holding more than ``block_rows`` templates is split
    into salted parts on one side while the other side is copied to every
    part, so a crowded exception class is compared by many tasks, not one;
    every candidate pair is still compared exactly once.

    Before ``levenshtein`` a bound that loses no pair: one edit takes at
    most two of a text's character pairs away, so texts within ``d`` edits
    have at most ``2 * d`` pairs (bits of their bitmaps) that the other has
    not. Counting bits costs a few machine words a pair, and most unrelated
    templates end there.
    """
    k = (keys.select("exception_class", "template").distinct()
         .select("*", *_pair_bits(F.col("template")))
         .withColumn("len", F.length("template"))
         .withColumn("band", _band(F.col("len"), threshold))
         .withColumn("cnull", F.col("exception_class").isNull())
         .withColumn("ckey", F.coalesce("exception_class", F.lit(""))))
    k = checkpoint(k)  # read five times below
    parts = (k.groupBy("cnull", "ckey", "band")
             .agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("parts")))
    bits = [f"bits{i}" for i in range(BITMAP)]
    a = (k.join(parts, ["cnull", "ckey", "band"])
         .select(*[F.col(c).alias(f"a_{c}") for c in ("exception_class", "template", "len", "band", "cnull",
                                                         "ckey", *bits)],
                 F.pmod(F.xxhash64("template"), F.col("parts")).cast("int").alias("a_part")))
    # every b row goes to the parts of the a blocks it can meet: same band and the band below
    b_same = k.join(parts, ["cnull", "ckey", "band"]).select(
        "*", F.col("band").alias("meet_band"))
    b_below = k.join(parts.withColumnRenamed("band", "meet_band").withColumn("band", F.col("meet_band") + 1),
                     ["cnull", "ckey", "band"])
    b = (b_same.unionByName(b_below)
         .select(*[F.col(c).alias(f"b_{c}") for c in ("exception_class", "template", "len", "band", "cnull",
                                                         "ckey", "meet_band", *bits)],
                 F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b_part")))
    cond = ((a["a_cnull"] == b["b_cnull"]) & (a["a_ckey"] == b["b_ckey"])
            & (a["a_band"] == b["b_meet_band"]) & (a["a_part"] == b["b_part"])
            & (((b["b_band"] == a["a_band"]) & (a["a_template"] < b["b_template"]))
               | (b["b_band"] == a["a_band"] + 1)))
    j = a.join(b, cond)
    m = F.greatest("a_len", "b_len")
    limit = (F.floor(m.cast("double") * (1.0 - threshold)) + 1).cast("int")
    possible = ((F.abs(F.col("a_len") - F.col("b_len")) <= limit)
                & (_bits_apart("a", "b") <= 2 * limit) & (_bits_apart("b", "a") <= 2 * limit))
    # one expression, so the optimizer can't put the distance before its
    # bound; past its limit (-1 edits) a pair counts as m edits apart
    edits = F.when(possible, F.pmod(F.call_function("levenshtein", F.col("a_template"), F.col("b_template"), limit), m + 1))
    sim = F.lit(1.0) - edits.cast("double") / m.cast("double")
    both = F.array(F.struct(F.col("a_template").alias("x"), F.col("b_template").alias("y")),
                   F.struct(F.col("b_template").alias("x"), F.col("a_template").alias("y")))
    return (j.withColumn("similarity", sim).filter(F.col("similarity") >= threshold)
            .select(F.col("a_exception_class").alias("exception_class"), F.explode(both).alias("_p"), "similarity")
            .select("exception_class", F.col("_p.x").alias("template_a"), F.col("_p.y").alias("template_b"), "similarity"))


def _scoped(by, col: str) -> Column:
    """``col`` together with the ``by`` columns, as one text key."""
    return F.to_json(F.struct(*by, col)) if by else F.col(col)


def _nodes(clusters: DataFrame, by=()) -> DataFrame:
    rank = F.struct((-F.col("occurrence_count")).alias("c"),
                    (-F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("t"),
                    F.col("fingerprint").alias("f"))
    lkey = F.when(F.col("primary_class").isNotNull(), F.struct(
        *by, "primary_class", "primary_method", "primary_line"))
    return clusters.select(
        _scoped(by, "fingerprint").alias("fingerprint"), rank.alias("rank"),
        _scoped(by, "exception_class").alias("exception_class"),
        normalize_message("message_pattern", "core").alias("template"), lkey.alias("lkey"))


def _neighbour_min(nodes: DataFrame, members: DataFrame, pairs: DataFrame, value, name: str) -> DataFrame:
    """For every row of ``nodes``: the least ``value`` over the ``members``
    related to it (same template group, similar template group, same
    location group); null when none. ``value`` is a column of members."""
    mkey = ["exception_class", "template"]
    g = (members.groupBy(*mkey).agg(F.min(value).alias("_g"))
         .withColumnRenamed("exception_class", "_x").withColumnRenamed("template", "_t"))
    via = (pairs.join(g, pairs["exception_class"].eqNullSafe(g["_x"]) & (pairs["template_b"] == g["_t"]))
           .groupBy(pairs["exception_class"], pairs["template"]).agg(F.min("_g").alias("_s"))
           .withColumnRenamed("exception_class", "_x2").withColumnRenamed("template", "_t2"))
    loc = members.filter(F.col("lkey").isNotNull()).groupBy("lkey").agg(F.min(value).alias("_l"))
    out = (nodes.join(g, nodes["exception_class"].eqNullSafe(g["_x"]) & (nodes["template"] == g["_t"]), "left")
           .drop("_x", "_t")
           .join(via, F.col("exception_class").eqNullSafe(F.col("_x2")) & (F.col("template") == F.col("_t2")),
                 "left").drop("_x2", "_t2")
           .join(loc, "lkey", "left"))
    return out.withColumn(name, F.least("_g", "_s", "_l")).drop("_g", "_s", "_l")


def merge_leaders(clusters: DataFrame, threshold: float = THRESHOLD,
                  materialize: bool = True, by=()) -> DataFrame:
    """``fingerprint -> leader`` (a leader maps to itself) of the greedy
    merge. With ``by`` columns (``app_id``) clusters merge within equal
    values only, and both columns hold the key of the columns and the
    fingerprint.

    Rounds decide who leads: an undecided cluster with no undecided earlier
    neighbour leads; undecided clusters next to a new leader are followers
    (they can never lead). Followers do not block anyone. When no cluster is
    undecided, every follower joins its earliest-ranked leader neighbour,
    which is the leader that reaches it first in the sequential loop.
    """
    nodes = _nodes(clusters, by)
    if materialize:
        nodes = checkpoint(nodes)
    pairs = similar_template_pairs(nodes.select("exception_class", "template"), threshold).select(
        "exception_class", F.col("template_a").alias("template"), F.col("template_b"))
    if materialize:
        pairs = checkpoint(pairs)
    undecided = nodes
    leaders = None
    while True:
        u = _neighbour_min(undecided, undecided, pairs, F.col("rank"), "_earliest")
        u = u.withColumn("_lead", F.coalesce(F.col("_earliest") >= F.col("rank"), F.lit(True))).drop("_earliest")
        if materialize:
            u = checkpoint(u)
        marked = _neighbour_min(u, u.filter("_lead"), pairs, F.lit(1), "_near")
        if materialize:
            marked = checkpoint(marked)
        new_leaders = marked.filter("_lead").select(*nodes.columns)
        undecided = marked.filter(~F.col("_lead") & F.col("_near").isNull()).select(*nodes.columns)
        leaders = new_leaders if leaders is None else leaders.unionByName(new_leaders)
        if undecided.isEmpty():
            break
    # leaders: a union of filters over checkpointed rounds, already a short lineage
    best = _neighbour_min(nodes, leaders, pairs,
                          F.struct(F.col("rank").alias("r"), F.col("fingerprint").alias("id")), "_best")
    is_leader = best.join(leaders.select("fingerprint", F.lit(True).alias("_is")), "fingerprint", "left")
    return is_leader.select("fingerprint", F.when(F.col("_is"), F.col("fingerprint"))
                            .otherwise(F.col("_best.id")).alias("leader"))


def merge_similar(clusters: DataFrame, threshold: float = THRESHOLD,
                  materialize: bool = True, by=()) -> DataFrame:
    """M1: clusters after the greedy merge. Counts add up, the seen range
    widens, pattern and class are the leader's; a leader without a location
    takes the location of its earliest-ranked absorbed cluster that has one;
    severity is redone.

    ``by`` names the columns that, with the fingerprint, are the key of
    ``clusters``; merges stay within equal values. A key that stands twice
    is an error: its counts would be added up more than once."""
    by = list(by)
    if materialize:
        clusters = checkpoint(clusters)
    twice = clusters.groupBy(*by, "fingerprint").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"clusters are not unique by {[*by, 'fingerprint']}: {twice[0].asDict()}")
    leaders = merge_leaders(clusters, threshold, materialize, by).withColumnRenamed("fingerprint", "_id")
    c = clusters.withColumn("_id", _scoped(by, "fingerprint")).join(leaders, "_id")
    rank = F.struct((-F.col("occurrence_count")).alias("c"),
                    (-F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("t"),
                    F.col("fingerprint").alias("f"))
    is_leader = F.col("_id") == F.col("leader")
    loc = F.struct("primary_file", "primary_line", "primary_method", "primary_class")
    agg = c.groupBy("leader").agg(
        F.sum("occurrence_count").alias("occurrence_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by(F.struct(*by, "cluster_id", "fingerprint", "exception_class", "message_pattern"),
                 F.when(is_leader, F.lit(1))).alias("_lead"),
        F.max_by(loc, F.when(is_leader, F.lit(1))).alias("_own_loc"),
        F.min_by(loc, F.when(~is_leader & F.col("primary_file").isNotNull(), rank)).alias("_taken"),
        F.count(F.lit(1)).alias("merged_clusters"))
    use = F.when(F.col("_own_loc.primary_file").isNotNull(), F.col("_own_loc")).otherwise(
        F.coalesce(F.col("_taken"), F.col("_own_loc")))
    return agg.select(
        *[F.col(f"_lead.{b}").alias(b) for b in by],
        F.col("_lead.cluster_id").alias("cluster_id"), F.col("_lead.fingerprint").alias("fingerprint"),
        F.col("_lead.exception_class").alias("exception_class"),
        F.col("_lead.message_pattern").alias("message_pattern"),
        use["primary_file"].alias("primary_file"), use["primary_line"].alias("primary_line"),
        use["primary_method"].alias("primary_method"), use["primary_class"].alias("primary_class"),
        "first_seen", "last_seen", "occurrence_count",
        severity("occurrence_count").alias("severity"), "merged_clusters")
