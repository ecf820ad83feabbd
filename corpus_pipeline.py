"""From raw documents to sharded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Whoever runs the stages writes each result
as Parquet and reads it again as the next stage's docs; ``run`` does so in the folder all executors share.
Null texts and texts without words are rejected by the first stage; empty tables pass through every stage;
extra columns are carried along under any name. What each stage does with ties, repeated rows and null ids
is said at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyshelf.llm import decontaminate, mix, neardup, quality, shard
from tallyshelf.llm.common import shared_folder, table
from tallyshelf.llm.q_shard import SHARDS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain policy keeps."""
    return quality.keep(docs, quality.PLAIN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of five-word shingles, the one of the least id."""
    return neardup.keep_first(docs, words=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources by code point weigh 1, 2, 3 in turn."""
    return mix.sample(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and the name of each one's shard."""
    return shard.place(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]

#: SQL does not express the filling of the shard table; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
