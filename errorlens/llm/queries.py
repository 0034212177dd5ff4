"""The registered queries of the corpus operators: thin digests of each
operator's result over whole tables. ``queries()`` and ``oracle_sql()`` are
added to the driver's by ``__spark_entry__.py``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (chat_format, classifier, collocations, decontaminate, fingerprints, licenses, lm_scores, mixing, secret_scan,
               sharding, simhash, token_alignment, token_rollup)
from .common import ensure_checkpoint_dir, table


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.text_shard_map(table(spark, sf_dir, "documents"), 40)


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return lm_scores.cross_entropy_difference(table(spark, sf_dir, "documents"), labels.where("quality = 1"))


def op4_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quartile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("_draw")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"
    tokenizers = {"bpe50k-1": token_rollup.bpe_counter(), "words-1": token_rollup.word_counter()}
    return token_rollup.corpus_rollup(table(spark, sf_dir, "documents"), folder, tokenizers).totals_by_batch()


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))[0]


def op9_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op10_benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_conversations(rows))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned_documents(table(spark, sf_dir, "documents"))


_QUERIES = [op1_minimax_shards, op2_simhash_components, op3_cross_entropy, op4_byte_convnet, op5_quartile_digests,
            op6_source_mix, op7_token_rollup, op8_secret_ledger, op9_license_bands, op10_benchmark_phrases,
            op11_collocations, op12_chat_format, op13_token_alignment]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op8_secret_ledger": secret_scan.SQL, "op11_collocations": collocations.SQL, "op12_chat_format": chat_format.DIGEST_SQL}
