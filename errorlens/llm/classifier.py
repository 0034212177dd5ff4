"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Learned
filters slide over the embedded bytes of a chunk and are max-pooled; the
chunks' features are combined (mean and maximum over the chunks, a hidden
layer) into one probability. Training runs on a bounded sample of labelled
rows; the parameters travel with the scoring tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, row_hash, utf8

CHUNK, STEP = 512, 448          # bytes of a chunk, and from one to the next
WIDTH, STRIDE = 12, 4           # bytes a filter sees, and its step
EMBED, FILTERS, HIDDEN = 8, 48, 24
PAD = 256                       # the symbol beyond the end of a text
#: The bounds of the training sample: rows of each class, bytes of a text.
TRAIN_ROWS, TRAIN_BYTES = 2000, 32768
ACCEPT = 0.3


@dataclass
class Network:
    """Parameters by name; ``prior`` is the score where nothing was learned."""
    p: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float | None = None

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        p = {"embed": f32(PAD + 1, EMBED, scale=0.5), "filters": f32(WIDTH * EMBED, FILTERS, scale=0.2),
             "bias": np.zeros(FILTERS, np.float32), "hidden": f32(2 * FILTERS + 2, HIDDEN, scale=0.2),
             "hidden_bias": np.zeros(HIDDEN, np.float32), "out": f32(HIDDEN, scale=0.3),
             "out_bias": np.zeros(1, np.float32)}
        p["embed"][PAD] = 0
        return cls(p)

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Max-pooled filter responses of chunks (rows of byte symbols), and
        where each maximum stands."""
        n = len(chunks)
        x = self.p["embed"][chunks]
        m = (CHUNK - WIDTH) // STRIDE + 1
        s = x.strides
        w = np.lib.stride_tricks.as_strided(x, (n, m, WIDTH * EMBED), (s[0], STRIDE * s[1], s[2]))
        y = (w.reshape(n * m, WIDTH * EMBED) @ self.p["filters"]).reshape(n, m, FILTERS)
        if places:
            at = y.argmax(axis=1)
            top = np.take_along_axis(y, at[:, None, :], 1)[:, 0, :] + self.p["bias"]
            return np.maximum(top, 0), at
        return np.maximum(y.max(axis=1) + self.p["bias"], 0)

    def head(self, mean: np.ndarray, top: np.ndarray, sizes: np.ndarray):
        """The probability from the pooled features and the bytes of each
        text: maxima over few windows are smaller."""
        long = np.log1p(sizes)[:, None] / 8, np.minimum(1, sizes / CHUNK)[:, None]
        f = np.concatenate([mean, top, *long], axis=1).astype(np.float32)
        h = np.tanh(f @ self.p["hidden"] + self.p["hidden_bias"])
        z = h @ self.p["out"] + self.p["out_bias"]
        return f, h, 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def chunk_starts(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and text number of every chunk; an empty text has one."""
    sizes = np.diff(ends)
    each = np.maximum(1, -(-np.maximum(sizes - CHUNK, 0) // STEP) + 1)
    doc = np.repeat(np.arange(len(sizes)), each)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    return ends[doc] + k * STEP, doc


def symbols(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The chunks at ``starts``, padded beyond the end of their text."""
    at = starts[:, None] + np.arange(CHUNK)
    beyond = at >= stops[:, None]
    if not len(raw):
        return np.full(at.shape, PAD, np.int16)
    out = raw[np.minimum(at, len(raw) - 1)].astype(np.int16)
    out[beyond] = PAD
    return out


def scores(net: Network, raw: np.ndarray, ends: np.ndarray, at_once: int = 128) -> np.ndarray:
    """The score of every text; whole texts of any length, a bounded number
    of chunks at once."""
    n = len(ends) - 1
    if net.prior is not None:
        return np.full(n, net.prior)
    starts, doc = chunk_starts(ends)
    total, top = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32)
    for at in range(0, len(doc), at_once):
        d = doc[at:at + at_once]
        y = net.pooled(symbols(raw, starts[at:at + at_once], ends[d + 1]))
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        total[d[first]] += np.add.reduceat(y, first, axis=0)
        top[d[first]] = np.maximum(top[d[first]], np.maximum.reduceat(y, first, axis=0))
    return net.head(total / np.bincount(doc, minlength=n)[:, None], top, np.diff(ends))[2]


def excerpt(text: str, r: np.random.Generator) -> str:
    """A run of some words of a text; a second training row of each text,
    so that short texts are seen in both classes."""
    size = int(np.exp(r.uniform(np.log(16), np.log(400))))
    at = int(r.integers(0, max(1, len(text) - size)))
    return text[at:at + size].partition(" ")[2] or text[:size]


def train(texts: list[str], labels: list[int], epochs: int = 10, batch: int = 32, rate: float = 3e-3,
          seed: int = 11) -> Network:
    """Fit by Adam on the cross-entropy. Maxima pass their gradient to one
    window each, so going back costs little beside going forth."""
    if len(set(labels)) < 2:
        return Network(prior=float(labels[0]) if labels else 0.5)
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    p = net.p
    texts, labels = [*texts, *(excerpt(t, r) for t in texts)], [*labels, *labels]
    raws = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    chunks = []
    for x in raws:
        starts, _ = chunk_starts(np.array([0, len(x)]))
        chunks.append(symbols(x, starts, np.full(len(starts), len(x))))
    sizes = np.array([len(x) for x in raws])
    y = np.array(labels, np.float64)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step, window = 0, np.arange(WIDTH)
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            x = np.concatenate([chunks[i] for i in rows])
            n_chunks = np.array([len(chunks[i]) for i in rows])
            begin = np.cumsum(n_chunks) - n_chunks
            pooled, place = net.pooled(x, places=True)
            mean = np.add.reduceat(pooled, begin, axis=0) / n_chunks[:, None]
            top = np.maximum.reduceat(pooled, begin, axis=0)
            f, h, prob = net.head(mean, top, sizes[rows])
            g: dict[str, np.ndarray] = {}
            dz = ((prob - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g["out"], g["out_bias"] = h.T @ dz, np.array([dz.sum()], np.float32)
            dh = dz[:, None] * p["out"] * (1 - h * h)
            g["hidden"], g["hidden_bias"] = f.T @ dh, dh.sum(axis=0)
            df = dh @ p["hidden"].T
            doc = np.repeat(np.arange(len(rows)), n_chunks)
            is_top = pooled >= top[doc]
            d = df[doc, :FILTERS] / n_chunks[doc][:, None] + df[doc, FILTERS:2 * FILTERS] * is_top
            d = (d * (pooled > 0)).astype(np.float32)
            g["bias"] = d.sum(axis=0)
            seen = np.take_along_axis(x[:, None, :], place[:, :, None] * STRIDE + window, 2)  # chunk, filter, byte
            e = p["embed"][seen].reshape(len(x), FILTERS, WIDTH * EMBED)
            g["filters"] = np.einsum("cf,cfw->wf", d, e, optimize=True)
            de = (d[:, :, None] * p["filters"].T[None]).reshape(-1, EMBED)
            g["embed"] = np.stack([np.bincount(seen.ravel(), de[:, k], PAD + 1) for k in range(EMBED)], 1).astype(np.float32)
            g["embed"][PAD] = 0
            step += 1
            now = rate * (0.5 if epoch >= epochs // 2 else 1) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] * g[k]
                p[k] = (p[k] - now * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def fold(doc_id: Column) -> Column:
    """0 for the held-out fifth of the ids."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Network:
    """The network fitted on the labelled rows outside the held-out fold: of
    each class the first ``rows`` ids by a hash, of them the texts of at
    most ``most_bytes`` bytes. An id labelled twice counts with its smaller
    label. No label is ever an input of a score."""
    marks = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    by_hash = [row_hash(F.lit(5), "doc_id"), F.col("doc_id")]
    picked = (marks.where("quality = 1").orderBy(*by_hash).limit(rows)
              .union(marks.where("quality = 0").orderBy(*by_hash).limit(rows)))
    ids = [(r[0], r[1]) for r in picked.collect()]
    if not ids:
        return train([], [])
    label = dict(ids)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, quality int").select("doc_id"))  # 2 * rows at most
    sample = (docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text")
              .join(wanted, "doc_id").collect())
    sample = sorted({(r[0], r[1]) for r in sample})
    return train([t for _, t in sample], [label[i] for i, _ in sample])


def scored(docs: DataFrame, net: Network, out: str = "score") -> DataFrame:
    """``docs`` with the score of each text, from its bytes alone. Null
    counts as empty; an empty text has a score like any other."""
    kept = docs.drop(out)
    names, text = kept.columns, kept.columns.index("text")
    plain = kept.toDF(*[f"c{i}" for i in range(len(names))])   # names of any kind, put back below

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(net, *utf8(b.column(text))))],
                                                 names=[*b.schema.names, "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{fields}, score double").toDF(*names, out)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``. A
    null id is not held out. Without labels every score is 0.5; with labels
    of one class it is that class. Repeated rows get equal scores; columns
    besides doc_id and text are ignored."""
    out = scored(docs.select("doc_id", "text"), fitted(docs.select("doc_id", "text"), labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier, fitted on the labelled rows
    of ``training``, doesn't reject, with their columns, whatever their names.

    Null and empty texts are scored like any other; null ids are kept; rows of
    equal text stay or go together; very long texts are scored whole. Without
    labels all rows stay; an empty table gives an empty one."""
    net = fitted(training.select("doc_id", "text"), labels)
    score, = free_names(docs, "score")
    return scored(docs, net, score).where(F.col(score) >= ACCEPT).drop(score)
