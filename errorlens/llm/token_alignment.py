"""Cross-tokenizer alignment: inverted pair bitmaps.

Two tokenizers cut the same bytes; where both cut, groups end, and the tokens
of a group are linked. For each slice of documents an inverted index holds,
for every pair of linked ids, a compressed bitmap of the slice's documents,
with bit planes of how often each document has the link. Parts of a slice are
OR-merged; popcounts of the bitmaps, added up over the slices, are the pairs'
document counts, and going through the postings gives the documents' scores.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_partitions, utf8
from .token_rollup import PIECES

#: The default vocabulary files: byte-level BPE (A), BPE pieces with byte fallback (B).
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes of a part (tokenized together) and of a slice (one index), about; documents of a slice at most.
PART_BYTES, SLICE_BYTES, SLICE_DOCS = 4_000_000, 16_000_000, 60_000
#: Bytes that the piece tokenizer gets at a time, about.
CALL_BYTES = 100_000
#: Links of a group over which equal ids of a side are counted before they are paired.
WIDE_GROUP = 4096
SPACE = 0x20


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE files write bytes: printable
    Latin-1 as itself, the other bytes as U+0100 and up, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabularies:
    """Both tokenizers, from the contents of their files, and the bytes of
    their tokens."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken
        model, alphabet = json.loads(byte_bpe)["model"], byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items()
                 if all(c in alphabet for c in t)}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("the ids of the byte-level vocabulary don't follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        #: no piece goes on over the end of a word, so words can be cut apart before tokenizing
        self.by_words = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces)
                                if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.lead = len(self.b.encode("a"))
        decimal = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.decimal = pa.array(decimal)

    def piece_ids(self, text: str) -> list[int]:
        """B ids of a text that begins with a space, the space included."""
        return self.b.encode("a" + text)[self.lead:] if text.strip(" ") == "" else self.b.encode(text[1:])


_BUILT: dict[bytes, Vocabularies] = {}


def vocabularies(files: tuple[bytes, bytes]) -> Vocabularies:
    key = hashlib.sha256(files[0] + files[1]).digest()
    if key not in _BUILT:
        _BUILT[key] = Vocabularies(*files)
    return _BUILT[key]


#: White space beyond ASCII, in UTF-8.
_WIDE_2 = np.array([0xC285, 0xC2A0])
_WIDE_3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def ends_word(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is surely no white space (and
    not U+2581): then both tokenizers cut at a space that follows."""
    code = np.zeros(len(at), np.int64)
    for k in (3, 2, 1):
        code = code << 8 | np.where(at >= k, raw[np.maximum(at - k, 0)], 0)
    last = code & 0xFF
    wide = np.isin(code & 0xFFFF, _WIDE_2) | np.isin(code, _WIDE_3) | (code == 0xE29681)
    return ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & ~wide)


class Cut(NamedTuple):
    """Distinct chunks of some texts with their tokens and links. Chunk i has
    A tokens a_at[i] to a_at[i + 1] and so on; links are (pair, times)."""
    bad: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    link_at: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    groups: list[bytes]


def _tokens(chunks: Sequence[bytes], closed: np.ndarray, v: Vocabularies) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For A and B: the ids of all chunks, how many each has, and whether its
    token bytes are not its own. Chunks that end in a word are tokenized
    strung together, others each by itself."""
    out = []
    for side in (0, 1):
        table = (v.a_bytes, v.b_bytes)[side]
        width = np.array([len(t) for t in table])
        one = (lambda t: v.a.encode_ordinary(t), v.piece_ids)[side]
        ids: list[np.ndarray] = []
        counts, bad = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), bool)
        i = 0
        while i < len(chunks):
            j, n = i, 0
            while j < len(chunks) and n < CALL_BYTES and (closed[j] or j == i):
                n, j = n + len(chunks[j]), j + 1
                if not closed[j - 1]:
                    break
            joined = b"".join(chunks[i:j])
            got = np.array(one(joined.decode("utf-8", "replace")), np.int64)
            if b"".join([table[x] for x in got.tolist()]) == joined:
                ids.append(got)
                ends = np.cumsum(width[got])
                upto = np.searchsorted(ends, np.cumsum([len(c) for c in chunks[i:j]]), side="right")
                counts[i:j] = np.diff(np.concatenate([[0], upto]))
            else:
                for k in range(i, j):
                    got = one(chunks[k].decode("utf-8", "replace"))
                    bad[k] = b"".join([table[x] for x in got]) != chunks[k]
                    if not bad[k]:
                        ids.append(np.array(got, np.int64))
                        counts[k] = len(got)
            i = j
        out.append((np.concatenate([np.zeros(0, np.int64), *ids]), counts, bad))
    return out


def _without(ids: np.ndarray, counts: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(~drop, counts)], np.where(drop, 0, counts)


def cut(chunks: list[bytes], closed: np.ndarray, v: Vocabularies) -> Cut:
    """Tokens, groups and links of distinct chunks; a chunk whose bytes the
    tokens of A or B don't give back is bad and has none."""
    (a, n_a, bad_a), (b, n_b, bad_b) = _tokens(chunks, closed, v)
    bad = bad_a | bad_b
    (a, n_a), (b, n_b) = _without(a, n_a, bad), _without(b, n_b, bad)
    sizes = np.where(bad, 0, [len(c) for c in chunks]).astype(np.int64)
    chunk_end = np.cumsum(sizes)
    total = int(chunk_end[-1]) if len(chunks) else 0
    a_end = np.cumsum(np.array([len(t) for t in v.a_bytes])[a])
    b_end = np.cumsum(np.array([len(t) for t in v.b_bytes])[b])
    ends = np.zeros(total + 1, np.uint8)
    ends[a_end] |= 1
    ends[b_end] |= 2
    group_end = np.flatnonzero(ends == 3)
    in_a, in_b = np.searchsorted(group_end, a_end), np.searchsorted(group_end, b_end)
    groups = len(group_end)
    of_a, of_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
    upto = np.searchsorted(group_end, chunk_end, side="right")
    n_groups = np.diff(np.concatenate([[0], upto]))
    chunk_of = np.repeat(np.arange(len(chunks)), n_groups)

    # links: each A token with each B token of its group
    wide = of_a * of_b > WIDE_GROUP
    first_b = np.cumsum(of_b) - of_b
    narrow = ~wide[in_a]
    reps = of_b[in_a[narrow]]
    of_link = np.repeat(np.flatnonzero(narrow), reps)
    step = np.arange(len(of_link)) - np.repeat(np.cumsum(reps) - reps, reps)
    pair = a[of_link] << 32 | b[first_b[in_a[of_link]] + step]
    chunk, times = chunk_of[in_a[of_link]], np.ones(len(pair), np.int64)
    first_a = np.cumsum(of_a) - of_a
    for g in np.flatnonzero(wide):
        x, nx = np.unique(a[first_a[g]:first_a[g] + of_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g]:first_b[g] + of_b[g]], return_counts=True)
        pair = np.concatenate([pair, (x[:, None] << 32 | y[None, :]).ravel()])
        times = np.concatenate([times, (nx[:, None] * ny[None, :]).ravel()])
        chunk = np.concatenate([chunk, np.full(len(x) * len(y), chunk_of[g])])
    if wide.any():
        order = np.argsort(chunk, kind="stable")
        pair, times, chunk = pair[order], times[order], chunk[order]
    link_at = np.searchsorted(chunk, np.arange(len(chunks) + 1))

    return Cut(bad, n_a, n_b, n_groups, link_at, pair, times, _group_texts(a, in_a, b, in_b, n_groups, v))


def _group_texts(a, in_a, b, in_b, n_groups, v: Vocabularies) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each chunk."""
    ids = np.concatenate([a, b])
    group, side = np.concatenate([in_a, in_b]), np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((np.arange(len(ids)), side, group))
    ids, group, side = ids[order], group[order], side[order]
    new_group = np.diff(group, prepend=-1) != 0
    starts = np.cumsum(n_groups) - n_groups
    opens = np.zeros(int(n_groups.sum()) + 1, bool)
    opens[starts[n_groups > 0]] = True
    # what stands before an id: nothing, "," in a side, "|" between sides, ";" between groups
    kind = np.where(new_group, np.where(opens[group], 0, 3), np.where(np.diff(side, prepend=0) != 0, 2, 1))
    text = pc.binary_join_element_wise(pa.array(["", ",", "|", ";"]).take(pa.array(kind)), v.decimal.take(pa.array(ids)), "")
    raw, ends = utf8(text)
    tokens_upto = np.searchsorted(group, np.cumsum(n_groups))
    at = ends[np.concatenate([[0], tokens_upto])]
    data = raw.tobytes()
    return [data[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]


class PairIndex:
    """Postings of one slice: sorted ``pairs`` (A id << 32 | B id), the
    documents of each as numbers in the slice, one pair after the other, and
    how often each document has the link. Stored, a pair in more than one of
    16 documents has a plain bitmap of the slice, others the list of the set
    bits; bit j of all multiplicities is a plane over the postings."""

    def __init__(self, n_docs: int, pairs: np.ndarray, counts: np.ndarray, docs: np.ndarray, times: np.ndarray):
        self.n_docs, self.pairs, self.counts, self.docs, self.times = n_docs, pairs, counts, docs, times

    @classmethod
    def of(cls, n_docs: int, pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> PairIndex:
        """From links in any order; those of one pair and document add up."""
        known, number = np.unique(pair, return_inverse=True)
        key = number * max(n_docs, 1) + doc
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        key = key[first]
        counts = np.bincount(key // max(n_docs, 1), minlength=len(known))
        return cls(n_docs, known, counts, key % max(n_docs, 1), times)

    @classmethod
    def merged(cls, parts: Sequence[PairIndex]) -> PairIndex:
        """The OR of the bitmaps of all parts over one slice; multiplicities
        of one document add up."""
        n = max((p.n_docs for p in parts), default=0)
        return cls.of(n, np.concatenate([np.zeros(0, np.int64), *(np.repeat(p.pairs, p.counts) for p in parts)]),
                      np.concatenate([np.zeros(0, np.int64), *(p.docs for p in parts)]),
                      np.concatenate([np.zeros(0, np.int64), *(p.times for p in parts)]))

    def dense(self) -> np.ndarray:
        return self.counts * 16 > self.n_docs

    def packed(self) -> dict[str, bytes]:
        dense, codec = self.dense(), pa.Codec("zstd")
        rows = np.repeat(dense, self.counts)
        bits = np.zeros((int(dense.sum()), self.n_docs), np.uint8)
        bits[np.repeat(np.arange(len(bits)), self.counts[dense]), self.docs[rows]] = 1
        planes = [np.packbits(self.times >> j & 1) for j in range(int(self.times.max(initial=0)).bit_length())]
        parts = {"pairs": self.pairs.astype("<i8"), "sizes": np.where(dense, 0, self.counts).astype("<i4"),
                 "bitmaps": np.packbits(bits, axis=1), "lists": self.docs[~rows].astype("<u2"),
                 "planes": np.concatenate([np.zeros(0, np.uint8), *planes])}
        return {k: len(x := p.tobytes()).to_bytes(8, "little") + codec.compress(x, asbytes=True) for k, p in parts.items()}

    @classmethod
    def unpacked(cls, n_docs: int, packed: dict[str, bytes]) -> PairIndex:
        """With only ``pairs``, ``sizes`` and ``bitmaps``: without postings."""
        codec = pa.Codec("zstd")
        raw = {k: codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) if x[:8] != bytes(8) else b""
               for k, x in packed.items()}
        pairs, sizes = np.frombuffer(raw["pairs"], "<i8"), np.frombuffer(raw["sizes"], "<i4").astype(np.int64)
        dense = sizes == 0
        words = np.frombuffer(raw["bitmaps"], np.uint8).reshape(int(dense.sum()), -1 if dense.any() else 0)
        counts = sizes.copy()
        counts[dense] = np.bitwise_count(words).sum(axis=1)  # popcounts
        none = np.zeros(0, np.int64)
        if "lists" not in raw:
            return cls(n_docs, pairs, counts, none, none)
        rows = np.repeat(dense, counts)
        docs = np.zeros(len(rows), np.int64)
        docs[~rows] = np.frombuffer(raw["lists"], "<u2")
        docs[rows] = np.nonzero(np.unpackbits(words, axis=1)[:, :n_docs])[1] if dense.any() else none
        planes = np.frombuffer(raw["planes"], np.uint8).reshape(-1, (len(docs) + 7) // 8) if len(docs) else []
        times = np.zeros(len(docs), np.int64)
        for j, plane in enumerate(planes):
            times |= np.unpackbits(plane)[:len(docs)].astype(np.int64) << j
        return cls(n_docs, pairs, counts, docs, times)

    def links(self) -> np.ndarray:
        """How often each pair is linked in the slice."""
        return np.add.reduceat(self.times, np.cumsum(self.counts) - self.counts) if len(self.pairs) else self.times

    def scores(self, of_pair: np.ndarray) -> np.ndarray:
        """For each document the sum of its links' values, whole numbers."""
        out = np.zeros(self.n_docs, np.int64)
        np.add.at(out, self.docs, np.repeat(of_pair, self.counts) * self.times)
        return out


_PER_DOC = (("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
            ("n_links", pa.int64()), ("groups_sha256", pa.string()))
_PACKED = ("pairs", "sizes", "bitmaps", "lists", "planes")


class _Slice:
    """Documents and index parts of a slice that is being filled."""

    def __init__(self):
        self.rows: list[list] = [[] for _ in _PER_DOC]
        self.parts: list[PairIndex] = []
        self.bytes = 0

    def add(self, doc_ids: pa.Array, texts: pa.Array, v: Vocabularies) -> None:
        """Some more documents: distinct chunks are cut once for all of them."""
        first, n = len(self.rows[0]), len(texts)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        held = np.asarray(pc.binary_length(texts)) > 0
        raw, ends = utf8(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        spaces = np.flatnonzero(raw[ends[0]:ends[-1]] == SPACE) + ends[0] if v.by_words else ends[:0]
        cuts = np.union1d(spaces[ends_word(raw, spaces)] if len(spaces) else spaces, ends)
        at_end = np.asarray(pc.is_in(pa.array(cuts[1:]), pa.array(ends))) if len(cuts) > 1 else np.zeros(0, bool)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]
                                                 ).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        index = np.asarray(coded.indices).astype(np.int64)
        closed = np.zeros(len(chunks), bool)
        closed[index] = np.where(at_end, ends_word(raw, cuts[1:]), True) & v.by_words
        got = cut(chunks, closed, v)
        doc = np.searchsorted(ends, cuts[:-1], side="right") - 1
        # empty texts, and texts with a chunk that the tokens don't give back, have none
        fine = held & (np.bincount(doc, got.bad[index], minlength=n) == 0)
        keep = fine[doc]
        index, doc = index[keep], doc[keep]
        sums = [np.bincount(doc, x[index], minlength=n).astype(np.int64) for x in (got.n_a, got.n_b, got.n_groups)]

        once, times = np.unique(doc * max(len(chunks), 1) + index, return_counts=True)
        in_doc, chunk = once // max(len(chunks), 1), once % max(len(chunks), 1)
        reps = np.diff(got.link_at)[chunk]
        link = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(got.link_at[chunk], reps)
        link_doc = np.repeat(in_doc, reps)
        link_times = got.times[link] * np.repeat(times, reps)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, link_doc, link_times)
        self.parts.append(PairIndex.of(first + n, got.pair[link], link_doc + first, link_times))

        bounds = np.searchsorted(doc, np.arange(n + 1)).tolist()
        chunk_list = index.tolist()
        hashed = [hashlib.sha256(b";".join([got.groups[c] for c in chunk_list[i:j]])).hexdigest() if j > i else ""
                  for i, j in zip(bounds, bounds[1:])]
        for to, more in zip(self.rows, (doc_ids.to_pylist(), *(s.tolist() for s in sums), n_links.tolist(), hashed)):
            to += more
        self.bytes += int(ends[-1] - ends[0])

    def row(self, number: int) -> pa.RecordBatch:
        """The slice as one row: lists over its documents, and the index."""
        packed = PairIndex.merged(self.parts).packed()
        columns = [pa.array([number], pa.int64()), *(pa.array([r], pa.list_(t)) for r, (_, t) in zip(self.rows, _PER_DOC)),
                   *(pa.array([packed[k]], pa.binary()) for k in _PACKED)]
        return pa.RecordBatch.from_arrays(columns, names=["slice", *(c for c, _ in _PER_DOC), *_PACKED])


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """The inverted index of ``docs``, a row for each slice: slice; lists over
    its documents of doc_id, n_a, n_b (tokens), n_groups, n_links and
    groups_sha256; and the packed `PairIndex`.

    Of each text a space and the text are tokenized, whole. Null and empty
    texts, and texts whose token bytes differ from that, have no tokens
    (groups_sha256 is empty). Equal words of a part are tokenized once.
    Repeated rows are documents each; null ids are kept; an empty table has
    no slices. Columns besides doc_id and text are ignored. The vocabulary
    files are read by the driver and travel with the tasks."""
    with open(byte_bpe, "rb") as x, open(piece_bpe, "rb") as y:
        files = x.read(), y.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, now, number = vocabularies(files), _Slice(), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
            part = np.cumsum(sizes) // PART_BYTES
            places = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
            for i, j in zip(places, places[1:]):
                for k in range(i, j, SLICE_DOCS):
                    rows = batch.slice(k, min(j - k, SLICE_DOCS))
                    if now.bytes and (now.bytes >= SLICE_BYTES or len(now.rows[0]) + rows.num_rows > SLICE_DOCS):
                        yield now.row(number)
                        now, number = _Slice(), number + 1
                    now.add(rows.column("doc_id"), rows.column("text"), v)
        if now.rows[0]:
            yield now.row(number)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    lists = ", ".join(f"{c} array<{kinds[t]}>" for c, t in _PER_DOC)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"slice long, {lists}, " + ", ".join(f"{c} binary" for c in _PACKED))


def _read(batch, i: int, columns: Sequence[str] = _PACKED) -> PairIndex:
    n = len(batch.column("n_a")[i])
    return PairIndex.unpacked(n, {k: batch.column(k)[i].as_py() for k in columns})


def slice_counts(index: DataFrame) -> DataFrame:
    """(slice, a, b, docs, links) of every pair of every slice: popcounts of
    the bitmaps and of the planes."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                got = _read(batch, i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(got.pairs), batch.column("slice")[i].as_py())), pa.array((got.pairs >> 32).astype(np.int32)),
                     pa.array((got.pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(got.counts), pa.array(got.links())],
                    names=["slice", "a", "b", "docs", "links"])
    return index.select("slice", "n_a", *_PACKED).mapInArrow(run, "slice long, a int, b int, docs long, links long")


def pair_counts(counts: DataFrame) -> DataFrame:
    """(a, b, docs, links, best) over all slices: documents that hold the pair
    linked, links, and whether no pair of the A id is in more documents."""
    pairs = counts.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(most, "a").select("a", "b", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))


def scored(index: DataFrame, counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents with n_best (links that are their A id's most frequent pair)
    and count_sum (the pair's documents, over all links), by going through
    the postings of each slice with the corpus' counts."""
    parts = shuffle_partitions(index.sparkSession)
    of_slice = counts.select("slice", "a", "b").join(pairs.select("a", "b", "docs", "best"), ["a", "b"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.combine_chunks().to_batches()[0]
        got = _read(row, 0)
        key = np.asarray(right["a"]).astype(np.int64) << 32 | np.asarray(right["b"]).astype(np.int64)
        order = np.argsort(key)
        if not np.array_equal(key[order], got.pairs):
            raise ValueError("counts of other slices")
        docs, best = np.asarray(right["docs"])[order], np.asarray(right["best"]).astype(np.int64)[order]
        lists = {c: row.column(c).flatten() for c, _ in _PER_DOC}
        return pa.table(lists | {"n_best": pa.array(got.scores(best)), "count_sum": pa.array(got.scores(docs))})

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return (index.repartition(parts, "slice").groupBy("slice").cogroup(of_slice.groupBy("slice"))
            .applyInArrow(run, out))


def aligned_documents(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256. Rows as in `align`; an empty table gives none."""
    index = checkpoint(align(docs, byte_bpe, piece_bpe))
    counts = slice_counts(index)
    pairs = checkpoint(pair_counts(counts))
    return scored(index, counts, pairs)


def pair_documents(index: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(a, b, doc_id, links) for every document that holds one of the given
    pairs linked: a lookup of their postings."""
    wanted = np.array(sorted({a << 32 | b for a, b in pairs}), np.int64)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                got = _read(batch, i)
                hit = np.repeat(np.isin(got.pairs, wanted), got.counts)
                key, ids = np.repeat(got.pairs, got.counts)[hit], batch.column("doc_id")[i].values
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)),
                     ids.take(pa.array(got.docs[hit])), pa.array(got.times[hit])], names=["a", "b", "doc_id", "links"])

    return index.select("doc_id", "n_a", *_PACKED).mapInArrow(run, "a int, b int, doc_id long, links long")
