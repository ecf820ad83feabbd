"""Query of the quality rules, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import quality
from tallyshelf.llm.common import shared_folder, table
from tallyshelf.llm.registry import query

_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS win
        FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM s WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY rid),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(list_zip(w[2:], w[:-2]), lambda p: p[1] = p[2]))::BIGINT AS n_stutter
      FROM s LEFT JOIN hit USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_stutter > 20 * n_words THEN 8 ELSE 0 END
         + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, NOT base_failed AND 10 * n_symbols <= n_words AND 100 * n_stutter <= 20 * n_words AS kept FROM v
"""


@query(_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, written once, and the plain policy read off its bits."""
    path = shared_folder(spark, "quality-ledger")
    quality.ledger(table(spark, sf_dir, "documents")).write.parquet(path)
    rows = quality.apply_policy(spark.read.parquet(path), quality.PLAIN)
    return rows.withColumn("base_failed", ~quality.passes(F.col("fail_bits"), quality.BASE))
