"""LM scoring: cross-entropy difference of two n-gram models.

A target model (chosen documents) and a background model (all documents)
share one vocabulary, one smoothing and one table of bigrams. The score of a
document is the mean over its tokens of the loss under the target model less
the loss under the background model: the lower, the more like the target.

`cross_entropy_difference` counts every word and bigram and cuts nothing: the
counts stay in tables that grow with the corpus, and each slice of texts is
sent the counts of its own words and bigrams. `fit` and `scored` are the small
form, with models cut to a bounded size, for callers that want to score other
texts with models they hold in memory.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, shuffle_partitions

#: For `fit` only. Of all tokens, a word of the vocabulary has a share of 2**-VOCABULARY_BITS
#: at least, a bigram of the table 2**-TABLE_BITS. So neither can have more
#: than 2**bits rows at any input size, which bounds what the scoring tasks
#: are sent; the counts themselves are taken over every word and bigram.
VOCABULARY_BITS, TABLE_BITS = 19, 20
#: Weight of the bigram estimate, and what is added to each word's count.
BIGRAM, ADDED = 0.7, 0.5
#: Bytes of target ids up to which they may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Tokens whose bigrams are counted at once.
TOKENS_AT_ONCE = 1 << 22
#: Counts that one task adds up, and groups of them that it takes in turn.
COUNTS_AT_ONCE, BUCKETS = 1 << 20, 4

_FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def word_hash(word: bytes) -> int:
    """Signed 64-bit hash that stands for a word. Never 0 or -1, which stand
    for the unknown word and the start of a text."""
    h = xxhash.xxh64_intdigest(word, 3)
    h = h - (1 << 64) if h >= 1 << 63 else h
    return h if h not in (0, -1) else 1


def _counted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, target, background): occurrences of every word, by its hash,
    in the documents with ``is_target`` and in all."""
    def run(b: pa.RecordBatch) -> dict:
        whole, chosen = Counter(), Counter()
        for text, target in zip(b.column("text").to_pylist(), b.column("is_target").to_pylist()):
            seen = tokens(text)
            whole.update(seen)
            if target:
                chosen.update(seen)
        return {"word": pa.array([word_hash(w) for w in whole], pa.int64()),
                "target": pa.array([chosen[w] for w in whole], pa.int64()),
                "background": pa.array(list(whole.values()), pa.int64())}
    return _counted(map_arrow(docs.select("text", "is_target"), run, "word long, target long, background long"), ["word"])


class Ids:
    """Numbers of words: 0 the unknown word, 1 the start of a text, then the
    vocabulary in the order of its hashes."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.size = len(vocabulary) + 2

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts in one row, and each text's count."""
        lists = [tokens(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        known: dict[bytes, int] = {}
        flat = np.fromiter((known.setdefault(w, len(known)) for x in lists for w in x), np.int64, int(counts.sum()))
        hashes = np.fromiter(map(word_hash, known), np.int64, len(known))
        at = np.searchsorted(self.vocabulary, hashes)
        if len(self.vocabulary):
            hit = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes
            number = np.where(hit, at + 2, 0)
        else:
            number = np.zeros(len(hashes), np.int64)
        return number[flat] if len(known) else flat, counts

    def codes(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A code for each token and the one before it."""
        before = np.empty_like(words)
        before[1:] = words[:-1]
        starts = (np.cumsum(counts) - counts)[counts > 0]
        before[starts] = 1
        return before * self.size + words


def slices(counts: np.ndarray) -> Iterator[slice]:
    """Runs of texts of some `TOKENS_AT_ONCE` tokens; one text at least."""
    block = np.cumsum(counts) // TOKENS_AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(counts)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


def bigram_counts(docs: DataFrame, ids: Ids) -> DataFrame:
    """(pair, target, background): occurrences of every bigram of word
    numbers in the documents with ``is_target`` and in all. Each task adds
    up its own before the shuffle, so a pair that stands in every document
    is a row for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("text").to_pylist()
            chosen = np.array(b.column("is_target").to_pylist(), dtype=bool)
            rough = np.array([len(t or "") // 4 for t in texts], dtype=np.int64)
            for part in slices(rough):
                words, counts = ids.of(texts[part])
                pairs, at = np.unique(ids.codes(words, counts), return_inverse=True)
                whole = np.bincount(at, minlength=len(pairs))
                picked = np.bincount(at, np.repeat(chosen[part], counts), minlength=len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(picked), pa.array(whole.astype(np.int64))],
                                                 names=["pair", "target", "background"])
    rows = docs.select("text", "is_target").mapInArrow(run, "pair long, target long, background long")
    return _counted(rows, ["pair"])


class Models:
    """Both models, as arrays of a bounded size."""

    def __init__(self, ids: Ids, words: dict[str, np.ndarray], pairs: np.ndarray, counts: dict[str, np.ndarray]):
        """``words`` and ``counts``: by model, the counts of the word numbers
        (the unknown word has all others) and of the table's pairs."""
        self.ids, self.pairs = ids, pairs
        self.unigram, self.bigram, self.backoff = {}, {}, {}
        first = pairs // ids.size
        for m, c in words.items():
            total = c.sum()
            self.unigram[m] = (c + ADDED) / (total + ADDED * len(c))
            # what precedes a token: any word, or a text's start
            history = np.maximum(np.bincount(first, counts[m], minlength=ids.size), c)
            share = np.divide(counts[m], history[first], out=np.zeros(len(pairs)), where=history[first] > 0)
            self.bigram[m] = BIGRAM * share
            # the weight that the table's bigrams leave to the unigrams
            self.backoff[m] = 1 - np.bincount(first, self.bigram[m], minlength=ids.size)

    def losses(self, words: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Loss of every token (in nats) by model."""
        codes, at = np.unique(self.ids.codes(words, counts), return_inverse=True)
        place = np.searchsorted(self.pairs, codes)
        if len(self.pairs):
            hit = self.pairs[np.minimum(place, len(self.pairs) - 1)] == codes
        else:
            hit = np.zeros(len(codes), bool)
        out = {}
        for m in self.unigram:
            p = self.backoff[m][codes // self.ids.size] * self.unigram[m][codes % self.ids.size]
            p[hit] += self.bigram[m][place[hit]]
            out[m] = -np.log(p)[at]
        return out


def fit(docs: DataFrame) -> Models:
    """Both models from ``docs`` (text, is_target). The driver gets the
    vocabulary and the table, at most 2**bits rows each by their rule."""
    words = checkpoint(word_counts(docs))
    total = words.agg(F.sum("background"), F.sum("target")).first()
    total = {"background": total[0] or 0, "target": total[1] or 0}
    least = total["background"] / (1 << VOCABULARY_BITS)
    kept = words.where(F.col("background") >= least).toPandas().sort_values("word")
    ids = Ids(kept["word"].to_numpy(np.int64))
    counts = {}
    for m in ("target", "background"):
        known = kept[m].to_numpy(np.float64)
        counts[m] = np.concatenate([[total[m] - known.sum(), 0], known])
    pairs = checkpoint(bigram_counts(docs, ids))
    least = total["background"] / (1 << TABLE_BITS)
    table = pairs.where(F.col("background") >= least).toPandas().sort_values("pair")
    return Models(ids, counts, table["pair"].to_numpy(np.int64),
                  {m: table[m].to_numpy(np.float64) for m in counts})


def scored(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the bits of fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("text").to_pylist()
            doc_ids = b.column("doc_id")
            rough = np.array([len(t or "") // 4 for t in texts], dtype=np.int64)
            for part in slices(rough):
                words, counts = both.ids.of(texts[part])
                text = np.repeat(np.arange(len(counts)), counts)
                loss = both.losses(words, counts)
                n = np.maximum(counts, 1)
                mean = {m: np.bincount(text, x, minlength=len(counts)) / n for m, x in loss.items()}
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(part.start, len(counts)), pa.array(counts), pa.array(mean["target"]),
                     pa.array(mean["background"]), pa.array(mean["target"] - mean["background"])],
                    names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def with_target(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, text, is_target: whether the id is in ``target_ids`` (column
    doc_id). The ids are broadcast if they are within `BROADCAST_BYTES`,
    else joined by shuffle."""
    ids = checkpoint(target_ids.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
                     .withColumn("is_target", F.lit(True)))
    side = F.broadcast(ids) if ids.count() * 24 <= BROADCAST_BYTES else ids
    out = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))


def to_blob(a: np.ndarray) -> bytes:
    """The array's bytes, compressed, after their number. All first bytes of
    the values stand before all second ones, which compress better so."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def from_blob(blob: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash that stands for a pair of word hashes."""
    x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Some texts as numbers of the slice's own words; the number after the
    last word is the start of a text. What is counted in a slice, in this
    order: each word (of the start: the texts with words), each word as the
    first of a pair, each pair."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, counts: np.ndarray, chosen: np.ndarray):
        self.words, self.counts, self.chosen = words, counts, chosen
        self.known = len(vocabulary)
        self.ids = np.append(vocabulary, np.int64(-1))
        self.before = np.empty(len(words), np.int64)
        self.before[1:] = words[:-1]
        self.before[(np.cumsum(counts) - counts)[counts > 0]] = self.known
        self.pairs, self.at = np.unique(self.before * len(self.ids) + words, return_inverse=True)

    def keys(self) -> np.ndarray:
        """0 and -1, which are no words, tell a word's two counts from pairs.
        Only the keys of words' own counts are odd."""
        n = len(self.ids)
        out = np.concatenate([pair_hash(self.ids, np.zeros(n, np.int64)), pair_hash(self.ids, np.full(n, -1)),
                              pair_hash(self.ids[self.pairs // n], self.ids[self.pairs % n])]) & ~np.uint64(1)
        out[:self.known] |= np.uint64(1)
        return out

    def occurrences(self) -> dict[str, np.ndarray]:
        """By model, how often each key is there in the slice."""
        n, of = len(self.ids), {"background": np.ones(len(self.counts)), "target": self.chosen.astype(np.float64)}
        out = {}
        for m, texts in of.items():
            weight = np.repeat(texts, self.counts)
            word = np.bincount(self.words, weight, minlength=n)
            word[self.known] = texts[self.counts > 0].sum()
            out[m] = np.concatenate([word, np.bincount(self.before, weight, minlength=n),
                                     np.bincount(self.at, weight, minlength=len(self.pairs))]).astype(np.int64)
        return out

    def mean_loss(self, sums: np.ndarray, total: int, size: int) -> np.ndarray:
        """Mean loss (nats a token) of each text under the model whose counts
        of the keys are ``sums``; ``size``: words with the unknown and the start."""
        n = len(self.ids)
        word, head, pair = sums[:n], sums[n:2 * n], sums[2 * n:]
        history = np.maximum(word, head)
        first, second = self.pairs // n, self.pairs % n
        share = lambda x, of: np.divide(x, of, out=np.zeros(len(x)), where=of > 0)
        # the weight that a word's pairs leave to the unigrams
        backoff = 1 - BIGRAM * share(head, history)
        p = BIGRAM * share(pair, history[first]) + backoff[first] * (word[second] + ADDED) / (total + ADDED * size)
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        return np.bincount(text, -np.log(p)[self.at], minlength=len(self.counts)) / np.maximum(self.counts, 1)


def sliced(docs: DataFrame) -> DataFrame:
    """slice, size (number of keys), tokens, target (tokens of the documents
    with ``is_target``), parts (the arrays of a slice) of all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("text").to_pylist()
            chosen = np.array(b.column("is_target").to_pylist(), dtype=bool)
            ids = b.column("doc_id").fill_null(0).to_numpy()
            no_id = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            rough = np.array([len(t or "") // 4 for t in texts], dtype=np.int64)
            for part in slices(rough):
                lists = [tokens(t) for t in texts[part]]
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                known: dict[bytes, int] = {}
                flat = np.fromiter((known.setdefault(w, len(known)) for x in lists for w in x), np.int64, int(counts.sum()))
                del lists
                vocabulary, number = np.unique(np.fromiter(map(word_hash, known), np.int64, len(known)), return_inverse=True)
                s = Slice(vocabulary, number[flat], counts, chosen[part])
                parts = [vocabulary, s.words.astype(np.int32), counts, s.chosen, ids[part], no_id[part]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([2 * len(s.ids) + len(s.pairs)], pa.int64()),
                     pa.array([len(flat)], pa.int64()), pa.array([int(counts[s.chosen].sum())], pa.int64()),
                     pa.array([[to_blob(x) for x in parts]], pa.list_(pa.binary()))],
                    names=["slice", "size", "tokens", "target", "parts"])
    return docs.select("doc_id", "text", "is_target").mapInArrow(
        run, "slice long, size long, tokens long, target long, parts array<binary>")


def from_parts(parts: list[bytes]) -> tuple[Slice, np.ndarray, np.ndarray]:
    """The slice, its documents' ids and which of them are null."""
    vocabulary, words, counts, chosen, ids, no_id = map(
        from_blob, parts, (np.int64, np.int32, np.int64, np.bool_, np.int64, np.bool_))
    return Slice(vocabulary, words.astype(np.int64), counts, chosen), ids, no_id


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches, each taken out of Arrow by itself."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def bucket_of(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, a range of keys, and the order of the keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return bucket, np.argsort(keys, kind="stable")


def summed(slices_of: DataFrame, buckets: int) -> DataFrame:
    """slice, bucket, known, parts: for each slice the whole corpus' counts of
    its keys in a bucket; ``known`` adds up to the number of distinct words.

    A key is a single entry of a slice, however many documents have it, so
    no key has more entries than there are slices."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in rows_of(batches):
            s = from_parts(parts)[0]
            keys, counts = s.keys(), s.occurrences()
            bucket, order = bucket_of(keys, buckets)
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            whole = [keys[order], counts["target"][order], counts["background"][order]]
            for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                a = int(ends[k - 1]) if k else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([k], pa.int64()),
                     pa.array([[to_blob(x[a:ends[k]]) for x in whole]], pa.list_(pa.binary()))],
                    names=["slice", "bucket", "parts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, run in groupby(rows_of(batches), lambda r: r[1]):
            got = [(number, from_blob(parts[0], np.uint64), from_blob(parts[1], np.int64), from_blob(parts[2], np.int64))
                   for number, _, parts in run]
            keys, at = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
            known = int((keys & np.uint64(1)).sum())
            sums = [np.bincount(at, np.concatenate([g[c] for g in got]), minlength=len(keys)).astype(np.int64) for c in (2, 3)]
            a = 0
            for number, own, _, _ in got:
                place = at[a:a + len(own)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([k], pa.int64()), pa.array([0 if a else known], pa.int64()),
                     pa.array([[to_blob(x[place]) for x in sums]], pa.list_(pa.binary()))],
                    names=["slice", "bucket", "known", "parts"])
                a += len(own)

    sent = slices_of.select("slice", "parts").mapInArrow(send, "slice long, bucket long, parts array<binary>")
    return (sent.repartition(max(1, buckets // BUCKETS), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(add, "slice long, bucket long, known long, parts array<binary>"))


def scored_whole(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of
    ``docs`` (doc_id, text, is_target), by models of all its words and bigrams.
    The driver gets four sums."""
    parts = shuffle_partitions(docs.sparkSession)
    slices_of = checkpoint(sliced(docs))
    count, size, whole, chosen = slices_of.agg(F.count(F.lit(1)), F.sum("size"), F.sum("tokens"), F.sum("target")).first()
    buckets = BUCKETS * max(parts, -(-(size or 0) // COUNTS_AT_ONCE))
    sums = checkpoint(summed(slices_of, buckets))
    words = (sums.agg(F.sum("known")).first()[0] or 0) + 2
    totals = {"target": chosen or 0, "background": whole or 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(rows_of(batches), lambda r: r[0]):
            s, ids, no_id = from_parts(next(rows)[2])
            order = bucket_of(s.keys(), buckets)[1]
            got = [[from_blob(x, np.int64) for x in r[2]] for r in rows]
            mean = {}
            for c, m in enumerate(("target", "background")):
                counts = np.empty(len(order), np.int64)
                counts[order] = np.concatenate([g[c] for g in got])
                mean[m] = s.mean_loss(counts, totals[m], words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=no_id), pa.array(s.counts), pa.array(mean["target"]), pa.array(mean["background"]),
                 pa.array(mean["target"] - mean["background"])],
                names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    both = slices_of.select("slice", F.lit(-1).cast("long").alias("bucket"), "parts").unionByName(
        sums.select("slice", "bucket", "parts"))
    return both.repartition(max(parts, count), "slice").sortWithinPartitions("slice", "bucket").mapInArrow(
        run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and
    score, their difference, of every row of ``docs``; the target model is
    that of the rows whose doc_id is in ``target_ids``.

    A text without tokens (null, empty) has losses and score 0. Without any
    target row the target model knows the vocabulary only. Repeated rows
    count as often as they are there and get equal scores; a null id is no
    target; other columns are ignored; an empty table gives an empty
    result."""
    return scored_whole(with_target(docs, target_ids))
