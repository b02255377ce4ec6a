"""A training corpus from ``documents``: five stages, each a Spark job over all that the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows are
written as Parquet and read back as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodgeprice.llm import decontam, minhash, mixing, quality, sharding
from lodgeprice.llm.common import read, written

SHARDS = 40
#: Jaccard similarity, in per cent, from which documents are near duplicates here.
NEAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the rule ensemble scores 0.5 or more."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return minhash.keep_one(docs, NEAR)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    return decontam.drop_leaking(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin out documents to the sources' targets."""
    return mixing.mix(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every row a shard and a slot."""
    return sharding.shard_report(docs, SHARDS)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: The classifier is trained; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
