"""Query of the sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyshelf.llm import shard
from tallyshelf.llm.common import table
from tallyshelf.llm.registry import query

SHARDS = tuple(f"shard-{k:03d}" for k in range(128))


# The table is filled turn by turn, which SQL does not express; the tests fill it by another way.
@query()
def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.place(table(spark, sf_dir, "documents"), SHARDS, slot_into="slot").select("doc_id", "slot", "shard")
