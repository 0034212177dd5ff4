"""License scans: MinHash bands over overlapping text windows.

DataFrame operations only. Templates are cut into pieces of some word
shingles. The texts are cut into overlapping windows of twice a piece's
size, so that every run of a piece's length lies whole in a window. A
window and a piece that share a MinHash band are candidates; the exact
containment of the template's shingles decides.

Only windows that hold some template shingle can share a band value (a band
value is the hash of a shingle of both), so signatures are made for those
windows alone; which windows these are is found by a join on the shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpoint, row_hash
from .decontaminate import bounded, words

#: Words of a shingle; a template of fewer words is one shingle.
SHINGLE = 5
#: Shingles of a piece at most; pieces fall into the classes 1, 2, 4, 8, 16.
PIECE = 16
#: Bands of one row. A window has at most 2 * class shingles, a piece over
#: half a class, of which 0.8 are there in a match: a Jaccard similarity of
#: 0.19 at least, so a band is shared with a probability of 1 - 0.81 ** 64,
#: over 0.999998. In class 1 the window is the shingle and all bands agree.
BANDS = 64
CONTAINED = 0.8
#: Template shingles up to which texts are tested for any of them first.
LITERALS = 10_000

#: Notices by licence. Fixed values.
NOTICES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                 "and/or sell copies of the Software",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met",
    "all-rights-reserved": "All rights reserved.",
}


def templates(spark: SparkSession, notices: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((NOTICES if notices is None else notices).items()), "license string, text string")


def shingles(w: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words, in order; ``w`` ends with the
    empty term and holds the words' hashes."""
    each = ", ".join(f"w[i + {k}]" for k in range(n))
    return F.expr(f"CASE WHEN size(w) > {n} THEN transform(sequence(0, size(w) - 1 - {n}), i -> xxhash64({n}, {each})) "
                  "ELSE cast(array() as array<bigint>) END")


def _pieces(marks: DataFrame) -> DataFrame:
    """(license, length, whole, offset, piece, class): the shingle hashes of
    each template (whole) and of its pieces."""
    held = marks.select("license", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    held = held.select("license", "w", F.least(F.size("w") - 1, F.lit(SHINGLE)).alias("length")).where("length > 0")
    whole = F.coalesce(*[F.when(F.col("length") == n, shingles(F.col("w"), n)) for n in range(1, SHINGLE + 1)])
    cut = held.select("license", "length", whole.alias("whole"))
    each = cut.select("*", F.explode(F.expr(f"sequence(0, size(whole) - 1, {PIECE})")).alias("offset"))
    each = each.withColumn("piece", F.expr(f"slice(whole, offset + 1, {PIECE})"))
    return each.withColumn("class", F.expr("cast(pow(2, ceil(log2(size(piece)))) as int)")).distinct()


def signature(hashes: Column) -> Column:
    """MinHash values of an array of shingle hashes."""
    def permuted(k: int) -> Column:
        return F.transform(hashes, lambda h: F.xxhash64(F.lit(k), h))
    return F.array(*[F.array_min(permuted(k)) for k in range(BANDS)])


def license_matches(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, license, start, n_words, containment): a row for each place
    of ``docs`` that contains at least 0.8 of the distinct shingles of a
    template of ``marks`` (license, text). ``start`` is the number of the
    word (from 0) where the template begins there, by its first shingle
    found; ``n_words`` is the template's length.

    Null, empty and wordless texts and templates match nothing. A row equal
    to another in id and text gives no rows of its own; null ids are kept.
    Other columns are ignored. What is made of the templates is broadcast
    within a measured size; beyond it Spark joins by shuffle."""
    pieces = checkpoint(_pieces(marks))
    lengths = sorted(r[0] for r in pieces.select("length").distinct().collect())
    if not lengths:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, license string, start int, n_words int, containment double")
    wanted = checkpoint(pieces.select(F.explode("piece").alias("h"), "length", "class").distinct())

    held = docs.select("doc_id", row_hash(F.coalesce(F.col("text"), F.lit(""))).alias("key"),
                       F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    # the shingles of all lengths in one array; those of a length start at its base
    arrays = [shingles(F.col("w"), n) for n in lengths]
    # one row from one row: the optimizer can't copy the expression into the
    # filter and the uses below
    rows = held.select("doc_id", "key", F.size("w").alias("_n"), F.explode_outer(F.array(F.concat(*arrays))).alias("h"))
    known = [r[0] for r in wanted.select("h").distinct().limit(LITERALS + 1).collect()]
    if len(known) <= LITERALS:
        rows = rows.where(F.arrays_overlap("h", F.array(*[F.lit(x) for x in known])))
    base, bases = F.lit(0), {}
    for n in lengths:
        bases[n] = base
        base = base + F.greatest(F.col("_n") - n, F.lit(0))
    found = rows.select("doc_id", "key", "_n", "h", F.posexplode_outer("h").alias("at", "x")).join(
        bounded(wanted, F.lit(32)), F.col("x") == wanted["h"]).select("doc_id", "key", "_n", rows["h"], "at", "length", "class")
    start = F.coalesce(*[F.when(F.col("length") == n, b) for n, b in bases.items()])
    found = found.withColumn("base", start).withColumn("count", F.greatest(F.col("_n") - F.col("length"), F.lit(0)))
    # the windows over a place: its own class step and the one before
    own = F.floor((F.col("at") - F.col("base")) / F.col("class")).cast("int")
    steps = F.when(F.col("class") == 1, F.array(own)).otherwise(F.array_distinct(F.array(own, F.greatest(own - 1, F.lit(0)))))
    cut = F.expr("slice(h, base + window * class + 1, least(if(class = 1, 1, 2 * class), count - window * class))")
    at = ["doc_id", "key", "length", "class", "window"]
    wins = (found.select("*", F.explode(steps).alias("window")).select(*at, cut.alias("hashes")).dropDuplicates(at))
    bands = wins.select(*at, "hashes", F.posexplode_outer(signature(F.col("hashes"))).alias("band", "value"))
    marked = checkpoint(pieces.select("license", "length", "class", F.posexplode_outer(signature(F.col("piece"))).alias("band", "value"))
                        .distinct())
    candidates = bands.join(bounded(marked, F.length("license") + 32), ["length", "class", "band", "value"]).select(*at, "license", "hashes").dropDuplicates([*at, "license"])

    whole = checkpoint(pieces.select("license", "length", "whole").distinct())
    met = candidates.join(bounded(whole, F.length("license") + F.size("whole") * 8 + 32), ["license", "length"]).select(
        "doc_id", "key", "license", "length", "class", "whole", (F.col("window") * F.col("class")).alias("_from"), "hashes",
        F.array_intersect("hashes", "whole").alias("common")).where("size(common) > 0")
    # where the template would start, by the window's first shingle of it
    met = met.withColumn("start", F.expr("_from + array_position(hashes, common[0]) - array_position(whole, common[0])").cast("int"))
    by = Window.partitionBy("doc_id", "key", "license").orderBy("start", "_from")
    apart = F.coalesce(F.col("start") - F.lag("start").over(by) > F.col("class"), F.lit(True))
    runs = met.withColumn("_new", apart.cast("int")).withColumn("place", F.sum("_new").over(by))
    one = runs.groupBy("doc_id", "key", "license", "place").agg(
        F.min(F.struct("start", "length", "whole")).alias("_m"),
        F.array_distinct(F.flatten(F.collect_list("common"))).alias("_common"))
    share = F.size("_common") / F.size(F.array_distinct(F.col("_m.whole")))
    return one.withColumn("containment", share).where(F.col("containment") >= CONTAINED).select(
        "doc_id", "license", F.greatest("_m.start", F.lit(0)).alias("start"),
        (F.size("_m.whole") + F.col("_m.length") - 1).alias("n_words"), "containment")
