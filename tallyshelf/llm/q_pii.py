"""Query of the personal data in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import pii
from tallyshelf.llm.common import table
from tallyshelf.llm.registry import query


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


# No SQL: the model's spans are no pattern. The tests hold the patterns against the plain regular expressions.
@query()
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.mark(docs, pii.fit(pii.sample(docs)), "found").select("doc_id", "found", F.filter("found", lambda s: s["base"]).alias("base"))
    return found.select("doc_id", *map(_count, pii.KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
