"""Query of the mix, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import mix
from tallyshelf.llm.common import table
from tallyshelf.llm.registry import query

_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE)
          / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight FROM d GROUP BY source),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight,
            source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, encode(source)
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE cap >= level * weight) * weight, cap)) AS target
      FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
h AS (SELECT *, target - copies * source_size AS missing,
        CASE WHEN source_size > 0 THEN (target - copies * source_size) / source_size ELSE 0 END AS part FROM g),
r AS (SELECT d.*, h.source_size, h.target, h.copies, h.missing, h.part, CASE WHEN part > 0 AND size > 0 THEN
        (u / (1 - u)) / (part / (1 - part) * (size / (size + 100.0::DOUBLE))) END AS q
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
c AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, key) AS upto FROM r),
k0 AS (SELECT *, q IS NOT NULL AND upto <= missing AS chosen,
         missing - coalesce(max(CASE WHEN q IS NOT NULL AND upto <= missing THEN upto END) OVER (PARTITION BY source), 0) AS left_over FROM c)
"""
# The places that close a sample, one after the other.
for _k in range(4):
    _SQL += f""",
n{_k} AS (SELECT *, CASE WHEN q IS NOT NULL AND NOT chosen AND size < 2 * left_over THEN
        row_number() OVER (PARTITION BY source, q IS NOT NULL AND NOT chosen AND size < 2 * left_over
                           ORDER BY abs(size - left_over), q, key) END AS place FROM k{_k}),
k{_k + 1} AS (SELECT * EXCLUDE (chosen, left_over, place), chosen OR coalesce(place = 1, false) AS chosen,
        left_over - coalesce(max(CASE WHEN place = 1 THEN size END) OVER (PARTITION BY source), 0) AS left_over FROM n{_k})"""
_SQL += """
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN chosen THEN 1 ELSE 0 END))::BIGINT AS taken FROM k4
"""


@query(_SQL)
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix.mix(docs, "m").select(
        "doc_id", "m.size", "m.source_size", "m.target", (F.col("m.size") * F.col("m.copies")).alias("taken"))
