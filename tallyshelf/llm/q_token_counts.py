"""Query of the token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import token_counts as tc
from tallyshelf.llm.common import join_small, shared_folder, table, word_count
from tallyshelf.llm.q_token_files import tokenizer_path
from tallyshelf.llm.registry import query
from tallyshelf.session import settle

BYTES, WORDS = "byte_bpe_50k/1", "words/1"


# No SQL: the tests count every text by the library alone.
@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under two tokenizer versions, counts are revised to hold an end id per
    document, and exact copies of an earlier document go again. One batch is committed twice."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text", word_count(F.col("text")).alias("words"), F.md5(F.coalesce("text", F.lit(""))).alias("print"))
    counts = settle(tc.count(docs, BYTES, tokenizer_path()).drop("text").withColumn("with_end", F.col("tokens") + 1))
    firsts = settle(counts.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    copies = settle(join_small(counts, firsts, ["print"], "inner", 96).filter("doc_id > first"))
    rollup = tc.Rollup(spark, shared_folder(spark, "token-counts"))
    rollup.commit("insert bytes", tc.inserted(counts, BYTES))
    rollup.commit("insert words", tc.inserted(counts, WORDS, "words"))
    rollup.commit("end ids", tc.revised(counts, BYTES, "tokens", "with_end"))
    rollup.commit("copies", tc.deleted(copies, BYTES, "with_end").unionAll(tc.deleted(copies, WORDS, "words")))
    rollup.commit("insert bytes", tc.inserted(counts, BYTES))
    rollup.compact()
    return rollup.totals()
