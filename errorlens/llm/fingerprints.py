"""Document fingerprints: a quartile bucket digest.

The byte triplets of every window of five bytes are hashed into buckets;
the digest holds the length on a log scale and, for every bucket, in which
quartile of all bucket counts its count lies. Two digests are compared by a
bounded difference score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, row_hash, shuffle_partitions, utf8

BUCKETS = 256
#: Places of the two later bytes of a triplet in its window of five.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
#: Bytes hashed at once.
STEP = 1 << 20
#: A step of the length code is this factor.
LENGTH_BASE = 1.1


def _bucket_counts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of the hashed triplets, a row for each text. ``ends`` has the
    ``n + 1`` offsets of the texts in ``raw``. Texts of any length: the
    bytes are taken in steps, with the overlap of a window."""
    n = len(ends) - 1
    counts = np.zeros(n * BUCKETS, dtype=np.int64)
    first, last = int(ends[0]), int(ends[-1])
    for start in range(first, last, STEP):
        stop = min(start + STEP, last)
        part = raw[start:min(stop + 4, last)].astype(np.uint32)
        at = np.arange(start, stop)
        doc = np.searchsorted(ends, at, side="right") - 1
        left = ends[doc + 1] - at  # bytes of the same text from here on
        base = doc * BUCKETS
        for salt, (j, k) in enumerate(TRIPLETS):
            m = len(part) - k
            if m <= 0:
                continue
            m = min(m, stop - start)
            h = part[:m] * np.uint32(0x9E3779B1) + part[j:j + m] * np.uint32(0x85EBCA77) \
                + part[k:k + m] * np.uint32(0xC2B2AE3D) + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            bucket = (h >> np.uint32(24)).astype(np.int64)
            fits = left[:m] > k
            counts += np.bincount((base[:m] + bucket)[fits], minlength=n * BUCKETS)
    return counts.reshape(n, BUCKETS)


def digests(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digest rows (uint8): the length code, then four buckets to a byte."""
    n = len(ends) - 1
    out = np.zeros((n, 1 + BUCKETS // 4), dtype=np.uint8)
    lengths = np.diff(ends)
    out[:, 0] = np.minimum(255, np.where(lengths > 0, 1 + np.log(np.maximum(lengths, 1)) / np.log(LENGTH_BASE), 0))
    # texts are counted in blocks whose count table stays small
    for at in range(0, n, 2048):
        stop = min(at + 2048, n)
        counts = _bucket_counts(raw, ends[at:stop + 1])
        order = np.sort(counts, axis=1)
        codes = np.zeros(counts.shape, dtype=np.uint8)
        for q in (1, 2, 3):
            codes += counts > order[:, [BUCKETS * q // 4 - 1]]
        four = codes.reshape(stop - at, BUCKETS // 4, 4)
        out[at:stop, 1:] = four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6
    return out


def encode_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    return np.frombuffer(b"".join(raws), np.uint8), ends


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference score of digest rows, 0 to 1: the summed distance of the
    quartile codes over its bound, plus a penalty for length codes more than
    two steps apart, cut at 1.

    The bucket counts of long texts come close to those of their language,
    so the same distance says more there. Unrelated texts of one language
    differ by about ``USUAL - PER_DECADE * log10(bytes)``, by the shorter
    one; the bound is ``SCALE`` times that, so a score of 0.5 lies between
    unrelated texts and texts that share two thirds."""
    codes = np.zeros(len(a))
    for s in (0, 2, 4, 6):
        x, y = (a[:, 1:] >> s & 3).astype(np.int16), (b[:, 1:] >> s & 3).astype(np.int16)
        codes += np.abs(x - y).sum(axis=1)
    lengths = a[:, 0].astype(np.float64), b[:, 0].astype(np.float64)
    shorter = np.maximum(np.minimum(*lengths) - 1, 0) * np.log10(LENGTH_BASE)
    bound = SCALE * np.clip(USUAL - PER_DECADE * shorter, LEAST, MOST)
    apart = np.abs(lengths[0] - lengths[1])
    return np.minimum(1.0, codes / bound + 0.005 * np.maximum(0, apart - 2))


#: The expected code distance of unrelated texts, and the scale of its bound.
USUAL, PER_DECADE, LEAST, MOST, SCALE = 450.0, 95.0, 25.0, 320.0, 1.7


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the difference score; 1 for equal digests."""
    return 1.0 - difference(a, b)


def _text_of(hexes: np.ndarray) -> list[str]:
    return [bytes(x).hex() for x in hexes]


COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compare(ids: list, texts: list[str], nexts: list[str]) -> dict:
    """The output columns for texts and the texts that follow them."""
    edited = []
    for t, x in zip(texts, nexts):
        k = len(t) // 3
        edited.append(t[:len(t) - k] + x[:k] if k else t)
    changed = digests(*encode_texts(edited))
    if texts[1:] == nexts[:-1]:  # neighbours in order: each next text is the row after
        chain = digests(*encode_texts([*texts, nexts[-1]]))
        own, after = chain[:-1], chain[1:]
    else:
        own, after = digests(*encode_texts(texts)), digests(*encode_texts(nexts))
    return {"doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            "fingerprint": pa.array(_text_of(own)), "edited_fingerprint": pa.array(_text_of(changed)),
            "near_edited": pa.array(likeness(own, changed)), "near_next": pa.array(likeness(own, after))}


def fingerprint_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a column ``fingerprint``; null text counts as empty."""
    schema = df.drop("fingerprint").schema
    names = schema.names

    def run(batches):
        for b in batches:
            if b.num_rows:
                own = digests(*utf8(b.column(text)))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(_text_of(own))],
                                                 names=[*names, "fingerprint"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.drop("fingerprint").mapInArrow(run, f"{fields}, fingerprint string")


def edited_likeness(docs: DataFrame, rows_at_once: int = 256) -> DataFrame:
    """Fingerprints of every text, of its edited text (the last third
    replaced by the start of the next document's), and their likeness.

    The next document is the one with the next smaller doc_id; after the
    last comes the first. Rows are ranged by descending doc_id (null last),
    equal ids by text hash; each task compares neighbours of its sorted
    range, and only the two rows at the ends of each range are matched over
    the ranges. A table of one row is its own next document; an empty table
    gives an empty result. Columns besides doc_id and text are ignored."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"),
                        row_hash(F.coalesce(F.col("text"), F.lit(""))).alias("_hash"),
                        F.monotonically_increasing_id().alias("_uid"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_hash"), F.col("_uid")]
    spread = (keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
              .select("doc_id", "text"))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: tuple | None = None
        first = True
        names = [f.split()[0] for f in COLUMNS.split(", ")]

        def out(cols: dict, part: int, ids: list, texts: list) -> pa.RecordBatch:
            n = len(cols["doc_id"]) if cols else len(ids)
            full = cols or {c: pa.nulls(n, t) for c, t in zip(names, TYPES)}
            # part 0: a finished row; 1 and 2: the first and last of a range
            mark = [part] * n
            return pa.RecordBatch.from_arrays(
                [*full.values(), pa.array(mark, pa.int32()), pa.array([pid] * n, pa.int32()),
                 pa.array(ids or [None] * n, pa.int64()), pa.array(texts or [None] * n, pa.string())],
                names=[*names, "_part", "_pid", "_id", "_text"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                rows = batch.slice(at, rows_at_once)
                ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
                if first:
                    yield out({}, 1, [ids[0]], [texts[0]])
                    first = False
                if held is not None:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1])
                if len(ids) > 1:
                    yield out(_compare(ids[:-1], texts[:-1], texts[1:]), 0, [], [])
        if held is not None:
            yield out({}, 2, [held[0]], [held[1]])

    done = checkpoint(spread.mapInArrow(neighbours, f"{COLUMNS}, _part int, _pid int, _id long, _text string"))
    # two rows a range: the last of one and the first of the next with rows
    ends = done.where("_part > 0").select("_part", "_pid", "_id", "_text")
    pids = sorted(r[0] for r in ends.where("_part = 1").select("_pid").collect())
    after = dict(zip(pids, [*pids[1:], *pids[:1]]))
    step = F.col("_pid")
    if after:
        step = F.element_at(F.create_map(*[F.lit(x) for p in after.items() for x in p]), F.col("_pid"))
    last = ends.where("_part = 2").select("_id", "_text", step.alias("_to"))
    start = ends.where("_part = 1").select(F.col("_pid").alias("_to"), F.col("_text").alias("_next"))
    names = [f.split()[0] for f in COLUMNS.split(", ")]

    def across(batches):
        for b in batches:
            if b.num_rows:
                cols = _compare(*(b.column(c).to_pylist() for c in ("_id", "_text", "_next")))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    joined = last.join(start, "_to").select("_id", "_text", "_next").mapInArrow(across, COLUMNS)
    return done.where("_part = 0").select(*names).unionByName(joined)


TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
