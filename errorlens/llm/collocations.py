"""Phrase collocation mining: weighted acyclic automata.

Shards of the corpus give their n-grams sorted. In every prefix range of their
union a count transducer is built incrementally, equal n-grams adding their
weights; the weight of a prefix is the sum over its range of paths, so one
longest n-gram per place counts all shorter ones. The counts of the parts of a
phrase are looked up by composing the parts' acceptor with the transducer of
the counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_partitions, utf8

#: Words of a phrase at most.
LONGEST = 5
#: Text bytes of a slice, about, and of all that a task holds of languages whose slices aren't full.
SLICE_BYTES, HELD_BYTES = 16_000_000, 64_000_000
#: Bits of a slice's number in its task, and of a count next to it.
SLICE_BITS, COUNT_BITS = 20, 23
#: Paths of one transducer, about.
PATHS = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: 0: a byte of a word, 1: between words, 2: ends a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Transducer:
    """A minimal acyclic automaton of sequences of labels, built state by
    state from sequences in an order that keeps equal prefixes together, and
    their weights by the rank of the path. States that accept the same are
    one state; a prefix is a range of ranks, its weight the sum over it."""

    def __init__(self, paths: Iterable[tuple[Sequence, int]]):
        self.arcs: list[dict] = []         # state: label -> (target, paths before the arc)
        self.final: list[bool] = []
        self.paths: list[int] = []         # state: number of paths from it
        known: dict[tuple, int] = {}
        weights: list[int] = []
        open_: list[tuple[list, list]] = [([], [])]   # of the last path: labels, targets
        ends, last = [False], ()

        def close(depth: int) -> None:
            while len(open_) > depth:
                labels, targets = open_.pop()
                key = (ends.pop(), tuple(labels), tuple(targets))
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    at, arcs = int(key[0]), {}
                    for label, target in zip(labels, targets):
                        arcs[label] = (target, at)
                        at += self.paths[target]
                    self.arcs.append(arcs)
                    self.final.append(key[0])
                    self.paths.append(at)
                if open_:
                    open_[-1][1].append(state)
                else:
                    self.root = state

        for path, weight in paths:
            if weights and path == last:
                weights[-1] += weight
                continue
            k = 0
            for x, y in zip(path, last):
                if x != y:
                    break
                k += 1
            close(k + 1)
            for label in path[k:]:
                open_[-1][0].append(label)
                open_.append(([], []))
                ends.append(False)
            ends[-1] = True
            weights.append(weight)
            last = path
        close(0)
        self.upto = np.concatenate([[0], np.cumsum(np.array(weights, dtype=np.int64))])

    def prefix(self, labels: Sequence) -> int:
        """The weight of all paths that begin with ``labels``."""
        state, rank = self.root, 0
        for label in labels:
            if label not in self.arcs[state]:
                return 0
            state, before = self.arcs[state][label]
            rank += before
        return int(self.upto[rank + self.paths[state]] - self.upto[rank])

    def prefixes(self, least: int, edges: Sequence[Sequence] = ()) -> Iterator[tuple[tuple, int]]:
        """All prefixes of a weight of ``least`` or more, and all of ``edges``."""
        kept = {tuple(e[:k]) for e in edges for k in range(1, len(e) + 1)}
        todo = [(self.root, 0, ())]
        while todo:
            state, rank, done = todo.pop()
            for label, (target, before) in self.arcs[state].items():
                path, first = (*done, label), rank + before
                weight = int(self.upto[first + self.paths[target]] - self.upto[first])
                if weight >= least or path in kept:
                    yield path, weight
                    todo.append((target, first, path))

    def compose(self, acceptor: Transducer) -> Iterator[tuple[tuple, int]]:
        """The paths of ``acceptor`` that this transducer has, with their own
        weights here; both are walked at once, common prefixes once."""
        todo = [(self.root, acceptor.root, 0, ())]
        while todo:
            state, other, rank, done = todo.pop()
            if self.final[state] and acceptor.final[other]:
                yield done, int(self.upto[rank + 1] - self.upto[rank])
            mine, theirs = self.arcs[state], acceptor.arcs[other]
            for label in (theirs if len(theirs) < len(mine) else mine):
                if label in mine and label in theirs:
                    target, before = mine[label]
                    todo.append((target, theirs[label][0], rank + before, (*done, label)))


# ---------------------------------------------------------------- shards

def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of texts (A-Z lower-cased) and the texts as word
    numbers from 1, with 0 where a piece ends."""
    raw, ends = utf8(texts)
    raw, ends = raw[ends[0]:ends[-1]], ends - ends[0]
    kind = _KIND[raw]
    inside = kind == 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(raw)]
    starts[edges] = inside[edges]
    at = np.flatnonzero(starts)
    narrow = np.int32 if len(raw) < 1 << 31 else np.int64
    offsets = np.append(np.cumsum(inside, dtype=narrow)[at] - 1, int(inside.sum())).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets),
                                                                          pa.py_buffer(_LOWER[raw[inside]])]).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=narrow)[at] + np.searchsorted(ends, at, side="right")
    ids = np.asarray(words.indices).astype(np.int32) + 1
    return words.dictionary, np.insert(ids, np.flatnonzero(np.diff(piece)) + 1, 0)


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unzip(packed: bytes) -> bytes:
    n = int.from_bytes(packed[:8], "little")
    return pa.Codec("zstd").decompress(packed[8:], n, asbytes=True) if n else b""


def _unpacked(row: pa.RecordBatch, i: int = 0) -> tuple[pa.Array, np.ndarray]:
    words = _unzip(row.column("words")[i].as_py())
    return (pa.array(words.split(b" ") if words else [], pa.binary()),
            np.frombuffer(_unzip(row.column("ids")[i].as_py()), np.int32))


def slices(docs: DataFrame) -> DataFrame:
    """Whole texts as rows of some megabytes of one language: slice, lang
    (null: ``und``), words (distinct) and ids (see `coded_words`), packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << SLICE_BITS

        def row(lang: str) -> pa.RecordBatch:
            nonlocal number
            words, ids = coded_words(pa.concat_arrays(held.pop(lang)))
            sizes.pop(lang)
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([lang]), pa.array([_zip(b" ".join(words.to_pylist()))], pa.binary()),
                 pa.array([_zip(ids.tobytes())], pa.binary())], names=["slice", "lang", "words", "ids"])

        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
            langs = batch.column("lang").dictionary_encode()
            size = np.cumsum(np.asarray(pc.binary_length(texts)))
            part = size // SLICE_BYTES
            codes = np.asarray(langs.indices)
            for p in np.unique(part):
                for code in np.unique(codes[part == p]):
                    lang, rows = langs.dictionary[int(code)].as_py(), np.flatnonzero((part == p) & (codes == code))
                    some = texts.take(pa.array(rows))
                    held.setdefault(lang, []).append(some)
                    sizes[lang] = sizes.get(lang, 0) + int(pc.sum(pc.binary_length(some)).as_py())
                    if sizes[lang] >= SLICE_BYTES:
                        yield row(lang)
                while sum(sizes.values()) >= HELD_BYTES:
                    yield row(max(sizes, key=sizes.get))
        for lang in list(held):
            yield row(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "slice long, lang string, words binary, ids binary")


def word_counts(parts: DataFrame) -> DataFrame:
    """(slice, lang, id, word, n) of every distinct word of every slice."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words, ids = _unpacked(batch, i)
                k = len(words)
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, batch.column("slice")[i].as_py())), pa.array([batch.column("lang")[i].as_py()] * k),
                         pa.array(np.arange(1, k + 1, dtype=np.int32)), words, pa.array(np.bincount(ids, minlength=k + 1)[1:])],
                        names=["slice", "lang", "id", "word", "n"])
    return parts.mapInArrow(run, "slice long, lang string, id int, word binary, n long")


def _with(parts: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(lang, words, ids, answers)`` for each slice with its answers."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.combine_chunks().to_batches()[0] if left.num_rows else None
        if row is None:
            raise ValueError("answers to no slice")
        return fn(row.column("slice")[0].as_py(), row.column("lang")[0].as_py(), *_unpacked(row), right)
    n = shuffle_partitions(parts.sparkSession)
    return (parts.repartition(n, "slice").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, schema))


def _pair_hashes(words: pa.Array, first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    hashes = np.array([0, *(xxhash.xxh64_intdigest(w) for w in words.to_pylist())], dtype=np.uint64)
    x = hashes[first] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh64_intdigest(lang))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[second]
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def pair_counts(parts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(pair, at): hashes of two neighbouring words that are both frequent, and
    the slice with the count in it, in one number. Two pairs of one hash only
    make the count too large."""
    def run(number, lang, words, ids, right):
        common = np.zeros(len(words) + 1, bool)
        common[np.asarray(right["id"])] = True
        both = common[ids[:-1]] & common[ids[1:]] if len(ids) else np.zeros(0, bool)
        code, n = np.unique(ids[:-1][both].astype(np.int64) << 32 | ids[1:][both], return_counts=True)
        pair = _pair_hashes(words, code >> 32, code & 0xFFFFFFFF, lang)
        most = (1 << COUNT_BITS) - 1
        rows = n // most + (n % most > 0)  # a count too large for its bits is several rows
        pair, n = np.repeat(pair, rows), np.where(np.arange(int(rows.sum())) < np.repeat(np.cumsum(rows) - 1, rows), most,
                                                  np.repeat(n - (rows - 1) * most, rows))
        return pa.table({"pair": pa.array(pair), "at": pa.array(n.astype(np.int64) | number << COUNT_BITS)})
    return _with(parts, frequent, run, "pair long, at long")


def longest_grams(parts: DataFrame, linked: DataFrame) -> DataFrame:
    """(lang, gram, n): of every place of every slice the longest n-gram up to
    `LONGEST` words all of whose pairs are ``linked`` (slice, pair); sorted,
    with its count. Each word of a gram is followed by a space, so that equal
    prefixes stand together in byte order."""
    def run(_, lang, words, ids, right):
        pairs = np.unique(np.asarray(right["pair"]))
        inner = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)) if len(ids) else np.zeros(0, np.int64)
        code, back = np.unique(ids[inner].astype(np.int64) << 32 | ids[inner + 1], return_inverse=True)
        good = np.isin(_pair_hashes(words, code >> 32, code & 0xFFFFFFFF, lang), pairs)
        link = np.zeros(len(ids) + LONGEST, bool)
        link[inner] = good[back]
        at = np.flatnonzero(link)
        columns, goes_on = [ids[at]], np.ones(len(at), bool)
        padded = np.concatenate([ids, np.zeros(LONGEST, np.int32)])
        for k in range(1, LONGEST):
            goes_on = goes_on & link[at + k - 1]
            columns.append(np.where(goes_on, padded[at + k], 0))
        if not len(at):
            return pa.table({"lang": pa.array([], pa.string()), "gram": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        for c in columns:
            new |= np.diff(c, prepend=-1) != 0
        first = np.flatnonzero(new)
        spaced = pa.concat_arrays([pa.array([b""]), pc.binary_join_element_wise(words, pa.scalar(b" "), pa.scalar(b""))])
        gram = pc.binary_join_element_wise(*[spaced.take(pa.array(c[first])) for c in columns], pa.scalar(b""))
        by = pc.sort_indices(gram)
        n = pa.array(np.diff(np.append(first, len(order))).astype(np.int64))
        return pa.table({"lang": pa.array([lang] * len(first)), "gram": gram.take(by), "n": n.take(by)})
    return _with(parts, linked, run, "lang string, gram binary, n long")


# ---------------------------------------------------------------- prefix ranges

def _chunks(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[list[tuple]]:
    """Sorted rows in lists of about ``PATHS``; equal (lang, gram) stay together."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if len(rows) >= PATHS and row[:2] != rows[-1][:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _path(lang: str, gram: bytes) -> tuple:
    return (lang, *gram[:-1].split(b" "))


def _by_range(df: DataFrame, *last: str) -> DataFrame:
    n = shuffle_partitions(df.sparkSession)
    return df.repartitionByRange(n, "lang", "gram").sortWithinPartitions("lang", "gram", *last)


def counted(grams: DataFrame, least: int) -> DataFrame:
    """(lang, gram, f): every n-gram of 2 words or more with at least
    ``least`` occurrences, from the longest n-grams of all shards.

    They are sorted over all shards by range; a chunk of a range becomes a
    transducer, and its prefixes' weights are sums over ranges of paths.
    Only prefixes of a chunk's first and last path can go on in another
    chunk; their parts are given whatever they weigh, and added up."""
    def run(batches):
        for rows in _chunks(batches, ("lang", "gram", "n")):
            paths = [(_path(lang, gram), n) for lang, gram, n in rows]
            found = [(p, w) for p, w in Transducer(paths).prefixes(least, (paths[0][0], paths[-1][0])) if len(p) > 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p, _ in found], pa.string()), pa.array([b" ".join(p[1:]) + b" " for p, _ in found], pa.binary()),
                 pa.array([w for _, w in found], pa.int64())], names=["lang", "gram", "f"])
    parts = _by_range(grams).mapInArrow(run, "lang string, gram binary, f long")
    return parts.groupBy("lang", "gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def looked_up(counts: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, gram, f) of the distinct ``parts`` (lang, gram): in every range
    the parts' acceptor is composed with the transducer of the counts."""
    def run(batches):
        for rows in _chunks(batches, ("lang", "gram", "f")):
            counted_ = Transducer((_path(lang, gram), f) for lang, gram, f in rows if f is not None)
            asked = Transducer((_path(lang, gram), 1) for lang, gram, f in rows if f is None)
            found = list(counted_.compose(asked))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p, _ in found], pa.string()), pa.array([b" ".join(p[1:]) + b" " for p, _ in found], pa.binary()),
                 pa.array([w for _, w in found], pa.int64())], names=["lang", "gram", "f"])
    both = counts.select("lang", "gram", "f").unionByName(
        parts.select("lang", "gram").distinct().withColumn("f", F.lit(None).cast("long")))
    return _by_range(checkpoint(both), "f").mapInArrow(run, "lang string, gram binary, f long")


def _cuts(phrases: DataFrame) -> DataFrame:
    """(lang, gram, f, k, first, rest): every phrase cut after its first k words."""
    word = F.regexp_extract_all(F.decode("gram", "ISO-8859-1"), F.lit("[^ ]* "), F.lit(0))
    back = lambda c: F.encode(F.array_join(c, ""), "ISO-8859-1")
    cut = (phrases.withColumn("_w", word).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w") - 1))))
    return cut.select("lang", "gram", "f", "k", back(F.slice("_w", F.lit(1), F.col("k"))).alias("first"),
                      back(F.slice("_w", F.col("k") + 1, F.lit(LONGEST))).alias("rest"), F.size("_w").alias("words"))


def collocations(docs: DataFrame, least: int = 100, best: int = 2000, covered: int = 100) -> DataFrame:
    """The ``best`` phrases of 2 to 5 words of each language: lang, rank (from
    1), phrase, a, l, r, n, score, by score, then a (both descending), then
    phrase (bytes).

    A phrase has at least ``least`` occurrences in the pieces of the whole
    texts, a; of its cuts the one with the lowest floor(1000*a*n/(l*r))
    counts, ties to the shorter first part. A phrase is left out if a longer
    one that holds it has at least ``covered`` percent of its count; it is
    enough to look at phrases longer by one word, for those between have no
    fewer occurrences.

    Only words, then pairs of words, that are frequent enough are kept on
    the way; all counts are whole. Null lang is ``und``, null text empty.
    Repeated rows count each. An empty table, or one without phrases, gives
    no rows. Columns besides lang and text are ignored."""
    parts = checkpoint(slices(docs))
    words = word_counts(parts)
    totals = checkpoint(words.groupBy("lang").agg(F.sum("n").alias("n")))
    total = lambda c, *key: F.sum(c).over(Window.partitionBy(*key))
    frequent = checkpoint(words.withColumn("f", total("n", "lang", "word")).where(F.col("f") >= least).drop("n"))
    common = frequent.select("lang", "word", "f").distinct()

    count = F.expr(f"at & {(1 << COUNT_BITS) - 1}")
    pairs = pair_counts(parts, frequent.select("slice", "id")).withColumn("_f", total(count, "pair"))
    linked = checkpoint(pairs.where(F.col("_f") >= least).select(F.shiftright("at", COUNT_BITS).alias("slice"), "pair"))
    phrases = checkpoint(counted(checkpoint(longest_grams(parts, linked)), least))

    cuts = checkpoint(_cuts(phrases))
    asked = cuts.select("lang", F.col("first").alias("gram")).union(cuts.select("lang", F.col("rest").alias("gram")))
    single = common.select("lang", F.encode(F.concat(F.decode("word", "ISO-8859-1"), F.lit(" ")), "ISO-8859-1").alias("gram"), "f")
    known = checkpoint(looked_up(single.unionByName(phrases), asked))
    left = known.select("lang", F.col("gram").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
              .withColumn("_salt", F.pmod(F.xxhash64("gram"), F.lit(64)))
              .join(totals.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))), ["lang", "_salt"])
              .withColumn("_top", F.lit(1000).cast("decimal(38,0)") * wide("f") * wide("n"))
              .withColumn("_low", wide("l") * wide("r"))
              .withColumn("score", F.expr("_top div _low")))
    lowest = scored.groupBy("lang", "gram").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("_x"), F.max("f").alias("a"), F.max("n").alias("n"))

    # cut after the first word or before the last one, the longer side is a phrase that this one holds
    ends = cuts.where("words > 2 and (k = 1 or k = words - 1)")
    inner = (ends.where("k = 1").select("lang", F.col("rest").alias("gram"), "f")
             .union(ends.where("k = words - 1").select("lang", F.col("first").alias("gram"), "f"))
             .groupBy("lang", "gram").agg(F.max("f").alias("_longer")))
    out = (lowest.join(inner, ["lang", "gram"], "left")
           .where(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a")))
           .select("lang", F.expr("cast(substring(gram, 1, octet_length(gram) - 1) as string)").alias("phrase"), "a",
                   "_x.l", "_x.r", "n", "_x.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = out.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The result of `collocations` in DuckDB.
SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, unnest(list_transform(range(1, 1 + least(5, len(w) - i + 1)), lambda k: w[i:i + k - 1])) AS g FROM places),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
phrases AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM counts WHERE len(g) >= 2),
cuts AS (SELECT p.lang, p.g, p.a, p.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * p.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM phrases p JOIN counts x ON x.lang = p.lang AND x.g = p.g[1:p.k] JOIN counts y ON y.lang = p.lang AND y.g = p.g[p.k + 1:]
  JOIN sizes s ON s.lang = p.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
held AS (SELECT lang, unnest([g[1:len(g) - 1], g[2:]]) AS g, f FROM counts WHERE len(g) >= 3),
longer AS (SELECT lang, g, max(f) AS f FROM held GROUP BY lang, g),
kept AS (SELECT z.*, array_to_string(z.g, ' ') AS phrase FROM lowest z LEFT JOIN longer o ON o.lang = z.lang AND o.g = z.g
  WHERE o.f IS NULL OR 100 * o.f < 100 * z.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
