"""From raw documents to token ids: five stages, each the input of the next.

run() applies them to the documents of a folder. Each stage's result is written as Parquet in the folder that executors
share and reread, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from gridloom.llm.common import mark, release, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before, exactly or within two edits (one for short lines), go; so do documents that have no other line."""
    return line_dedup.deduplicated(docs, minimum=1)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.without_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", copies), ("decontamination", leaks), ("tokens", tokens)]

# Hashed statistics, edit joins, components and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = mark()
        docs = stored(stage(spark, docs, sf_dir), name)
        release(before, docs)  # what the stage stored for itself; its result is written
    return STAGES[-1][1](spark, docs, sf_dir)
