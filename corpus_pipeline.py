"""The corpus pipeline: documents to shards, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; `run` writes its result as Parquet and reads it again for
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from errorlens.llm import classifier, decontaminate, mixing, sharding, simhash
from errorlens.llm.common import ensure_checkpoint_dir, table

#: The classifier and the draws can't be written in SQL; tests/llm checks
#: the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go.
    Null and empty texts are scored like any other, null ids are kept, rows of
    equal text go or stay together, an empty table gives an empty one."""
    return classifier.accepted(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id stays (rows
    without an id last); wordless and null texts are one component, repeated
    rows are one, an empty table gives an empty one."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go. Null and wordless texts
    stay, null ids are kept, repeated rows go or stay together."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target weight: documents that the mix doesn't take
    go, documents that it takes twice are there twice. Documents without words
    (null texts too) are taken with whole epochs only; a null source is one."""
    return mixing.mixed_rows(docs, mixing.mix(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in 40 shards as `op1_minimax_shards` gives them, written to the
    shared checkpoint folder and read back: the columns of documents, shard
    and slot. An empty table gives no rows."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, path)
    schema = docs.drop("shard", "slot").schema.add("slot", "long").add("shard", "integer")
    return spark.read.schema(schema).parquet(path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared
    checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
