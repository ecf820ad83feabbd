"""Query of the conversation repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import repair
from tallyshelf.llm.common import table
from tallyshelf.llm.registry import query


def damaged(rows: DataFrame) -> DataFrame:
    """The stated damage: by its checksum a row is dropped, emptied, cut off, repeated or given the role user."""
    space = F.lit(" ")
    said = F.coalesce("role", space), F.coalesce("text", space)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", said[0].alias("role"), said[1].alias("text"), (F.crc32(name.cast("binary")) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter("d <> 0").select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
                                        text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1))).alias("n")).drop("n")


_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256),
    lambda n: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), n)) AS crc),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
-- The checksum of the name, from the table of all bytes.
m AS (SELECT o.*, xor(list_reduce(list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT),
    lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 20 AS d FROM o, t),
w AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, unnest(CASE d WHEN 1 THEN [''] WHEN 3 THEN [text, text]
    WHEN 2 THEN [regexp_replace(text, '[.!?]', '', 'g')] ELSE [text] END) AS text FROM m WHERE d <> 0),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r FROM w),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS illegal FROM i),
-- The best of each state: s0 nothing yet, s1 after the system row, s2 after a user row, s3 after an assistant row.
b AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0, 'a': ''} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR) AS s1,
    {'c': 5, 'a': 'I'} AS s2, {'c': 10, 'a': 'II'} AS s3 FROM o
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, list_min([s3, CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 5, 'a': s2.a || 'I'} END])
  FROM (SELECT conv_id, i, s0, s1, s3, list_min([s2, CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 5, 'a': s0.a || 'I'} END,
      CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 5, 'a': s1.a || 'I'} END, CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 5, 'a': s3.a || 'I'} END]) AS s2
    FROM (SELECT b.conv_id, f.i, {'c': s0.c + 2, 'a': s0.a || 'D'} AS s0,
      list_min([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D'} END, CASE WHEN ok AND r = 's' THEN {'c': s0.c + x, 'a': s0.a || 'K'} END]) AS s1,
      list_min([CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'D'} END,
        CASE WHEN ok THEN {'c': s0.c + x + 1, 'a': s0.a || 'R'} END, CASE WHEN ok AND r = 'u' THEN {'c': s0.c + x, 'a': s0.a || 'K'} END,
        CASE WHEN ok AND s1 IS NOT NULL THEN {'c': s1.c + x + 1, 'a': s1.a || 'R'} END, CASE WHEN ok AND s1 IS NOT NULL AND r = 'u' THEN {'c': s1.c + x, 'a': s1.a || 'K'} END,
        CASE WHEN ok AND s3 IS NOT NULL THEN {'c': s3.c + x + 1, 'a': s3.a || 'R'} END, CASE WHEN ok AND s3 IS NOT NULL AND r = 'u' THEN {'c': s3.c + x, 'a': s3.a || 'K'} END]) AS s2,
      list_min([CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 2, 'a': s3.a || 'D'} END, CASE WHEN ok AND s2 IS NOT NULL THEN {'c': s2.c + x + 1, 'a': s2.a || 'R'} END,
        CASE WHEN ok AND s2 IS NOT NULL AND r = 'a' THEN {'c': s2.c + x, 'a': s2.a || 'K'} END]) AS s3
      FROM b JOIN (SELECT *, fault IN (0, 3) AS ok, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS x FROM f) f
        ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = b.i + 1))),
e AS (SELECT conv_id, list_min([s0, s3]) AS best FROM b QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
l AS (SELECT conv_id, p, best.a[p] AS edit FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS p FROM e)),
g AS (SELECT *, count(*) FILTER (edit <> 'I') OVER q AS i, count(*) FILTER (edit <> 'D') OVER q AS nth FROM l WINDOW q AS (PARTITION BY conv_id ORDER BY p)),
h AS (SELECT g.*, f.role, f.text, nth - max(CASE WHEN nth = 1 AND edit = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.conv_id) AS after_system
      FROM g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i),
j AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN after_system % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
      CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) FILTER (edit <> 'D') AS said FROM h GROUP BY conv_id),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
      count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
  sha256(coalesce(said, '')) AS repaired_sha256
FROM e LEFT JOIN j ON j.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query(_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.digests(repair.plan(damaged(rows)), rows.select("conv_id"))
