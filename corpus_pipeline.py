"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return rows with the columns of
documents; the last adds where its files are. Nulls, empty and long texts,
repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, mixing, near_copies, quality_classifier, sharding, simhash
from lodestar.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, then one of each group of near copies.

    Near duplicates have almost equal fingerprints; near copies share 0.8 of
    their five-word shingles, which fingerprints are too short to tell.
    """
    return near_copies.keep_one(materialize(near_duplicates(spark, docs, sf_dir), "near_duplicates"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of their sources takes them."""
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that holds them after compaction."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", unlike),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("sharding", shards),
]

#: SQL can't express the classifier, fingerprints or walks: the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
