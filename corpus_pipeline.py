"""The training-data pipeline: each stage works on what its predecessor kept.

Defined results: every stage takes nulls in any column, empty and very long texts, repeated rows,
empty tables and further columns of any name. A null id is an id like others for filtering, but such
rows are never learned from. All stages but the last hand on all columns of what they keep."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from skeingraph.llm import byte_bpe, chosen_path, decontaminate, language_id, line_crf
from skeingraph.runtime import delete_at_exit, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, no text (null or empty), or unlike all languages that
    were learned. Repeated rows share one verdict; where no row has a language to learn, all go."""
    model = language_id.fit(docs)
    return language_id.keep_known(docs, model, min_score=language_id.least_score(docs, model))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules (null and empty texts do), or whose lines are mostly
    boilerplate, go. Repeated rows share one verdict; without labels of both kinds only base rules count."""
    return line_crf.keep_good(docs, line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of a tie that of the smallest id, and of
    repeated rows one. Texts without words, null and empty ones included, all stay."""
    return chosen_path.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none, null and empty
    items are in none, and an empty benchmark removes nothing. Repeated rows share one verdict."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: how many token ids its text has, and digests of them and of what they
    decode to; null and empty texts have none. Repeated rows give repeated results."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: Fitted models and sequence decoding can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        delete_at_exit(spark, path)
        docs = spark.read.parquet(path)
    return docs
