"""Token counts: delta-maintained rollups.

Changes of documents (inserts, deletes, revised texts) become signed
differences of counts. A batch of differences is committed once under its
id; the totals by source, language and tokenizer version are the sum of all
committed batches, so no total is ever counted anew from the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow

KEYS = ("source", "lang", "tokenizer")
MEASURES = ("documents", "tokens", "chars")
#: The default vocabulary: byte-level BPE with 50,256 ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts a text into pieces for that vocabulary. A fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The tokenizer of a worker process by name, built once.
_BUILT: dict[str, Callable[[list[str]], list[int]]] = {}


def bpe_counter(path: str = VOCABULARY, pieces: str = PIECES) -> Callable[[], Callable[[list[str]], list[int]]]:
    """A maker of the counting function of a BPE vocabulary file. The ranks
    (of a fixed size) travel with the tasks; executors need no file."""
    with open(path, "rb") as f:
        lines = f.read()

    def make():
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        encoding = tiktoken.Encoding("file", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    return make


def word_counter() -> Callable[[], Callable[[list[str]], list[int]]]:
    """A maker of the count of runs other than white space (ASCII)."""
    return lambda: lambda texts: [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]


def text_key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def token_counts(docs: DataFrame, tokenizers: dict[str, Callable], key: Column | None = None) -> DataFrame:
    """(doc_id, key, source, lang, tokenizer, tokens, chars): a row for each
    row of ``docs`` and tokenizer version. ``key`` is by default a hash of
    the text. Null text counts 0."""
    def run(b: pa.RecordBatch) -> dict:
        texts = [t or "" for t in b.column("text").to_pylist()]
        n = len(texts)
        out = {c: pa.concat_arrays([b.column(c)] * len(tokenizers)) for c in ("doc_id", "key", "source", "lang")}
        tokens: list[int] = []
        for name, make in tokenizers.items():
            if name not in _BUILT:
                _BUILT[name] = make()
            tokens += _BUILT[name](texts)
        return out | {"tokenizer": pa.array([t for t in tokenizers for _ in range(n)]),
                      "tokens": pa.array(tokens, pa.int64()),
                      "chars": pa.array([len(t) for t in texts] * len(tokenizers), pa.int64())}
    rows = docs.select("doc_id", (text_key() if key is None else key).alias("key"),
                       F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return map_arrow(rows, run, "doc_id long, key string, source string, lang string, tokenizer string, "
                                "tokens long, chars long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Count rows as differences: 1 for inserts, -1 for deletes."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("documents"), (sign * F.col("tokens")).alias("tokens"),
                         (sign * F.col("chars")).alias("chars"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The differences of revised rows: the old counts out, the new ones in.
    A source or language that changed moves its counts along."""
    return signed(old, -1).unionByName(signed(new, 1))


def summed(differences: DataFrame) -> DataFrame:
    """Differences added up by key; added up in each task before the
    shuffle, so a source that holds most rows is a row for each task."""
    return differences.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


class Rollup:
    """Committed batches in a folder of the shared file system:
    ``batch=ID`` holds the summed differences of a batch and counts from the
    moment its ``_SUCCESS`` file exists."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """The ids of the committed batches, ascending."""
        if not self._fs.exists(self._path(self.path)):
            return []
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        ids = sorted(int(x[6:]) for x in folders if x.startswith("batch="))
        return [i for i in ids if self._fs.exists(self._path(f"{self.path}/batch={i}/_SUCCESS"))]

    def commit(self, batch: int, differences: DataFrame) -> bool:
        """Commit a batch once. A second commit of its id changes nothing
        and returns False; what a stopped commit left is overwritten."""
        if batch in self.committed():
            return False
        summed(differences).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self, upto: int | None = None) -> DataFrame:
        """documents, tokens and chars by source, lang and tokenizer: the sum
        of all committed batches, or of those up to one. Keys whose documents are all gone are
        left out; null sources and languages are keys like any other."""
        ids = [i for i in self.committed() if upto is None or i <= upto]
        if not ids:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, documents long, "
                                                  "tokens long, chars long")
        rows = self.spark.read.parquet(*[f"{self.path}/batch={i}" for i in ids])
        return summed(rows).where("documents <> 0 or tokens <> 0 or chars <> 0")

    def totals_by_batch(self) -> DataFrame:
        """``totals`` after each committed batch, with its id as ``batch``."""
        each = [self.totals(i).withColumn("batch", F.lit(i).cast("long")) for i in self.committed()]
        out = each[0] if each else self.totals().withColumn("batch", F.lit(0).cast("long"))
        for more in each[1:]:
            out = out.unionByName(more)
        return out

    def fold(self, batch: int) -> None:
        """Put the sum of all batches into one new batch of the id ``batch``
        (larger than all others) in another folder, so that the number of
        folders stays bounded; `self.path` then names that folder."""
        if batch <= max(self.committed(), default=-1):
            raise ValueError("the id of a fold must be new")
        whole, self_path = self.totals(), f"{self.path}-to-{batch}"
        whole.write.mode("overwrite").parquet(f"{self_path}/batch={batch}")
        self.path = self_path


def corpus_rollup(docs: DataFrame, path: str, tokenizers: dict[str, Callable]) -> Rollup:
    """The life of a corpus as three batches: every document inserted; exact
    copies deleted (all but the smallest doc_id of a text); the texts that
    have repeated lines revised to the text without the repeats. Batch 2 is
    committed twice, as by a job that was run again.

    Null text is an empty one. Rows equal in id and text are inserted as
    often as they are there; of them one stays. Columns other than doc_id,
    text, source and lang are ignored."""
    rollup, by = Rollup(docs.sparkSession, path), ["key", "tokenizer"]
    counts = checkpoint(token_counts(docs, tokenizers))
    rollup.commit(1, signed(counts, 1))

    at = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "source", "lang", "tokens", "chars")).alias("_at")
    stay = checkpoint(counts.groupBy(*by).agg(at).select(*by, "_at.source", "_at.lang", "_at.tokens", "_at.chars"))
    for _ in range(2):
        rollup.commit(2, revised(counts, stay))

    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    without = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).select(
        "doc_id", "source", "lang", F.array_join(F.array_distinct(lines), "\n").alias("text"), text_key().alias("_key"))
    after = (token_counts(without, tokenizers, F.col("_key")).groupBy(*by)
             .agg(F.min("tokens").alias("_tokens"), F.min("chars").alias("_chars")))
    both = checkpoint(stay.join(after, by))
    rollup.commit(3, revised(both, both.select("source", "lang", "tokenizer", F.col("_tokens").alias("tokens"),
                                               F.col("_chars").alias("chars"))))
    return rollup
