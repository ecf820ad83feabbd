"""Query of the near-duplicates, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import neardup
from tallyshelf.llm.common import table
from tallyshelf.llm.registry import query

_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS sh
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT sh, count(*) AS df FROM s GROUP BY sh),
-- Sets this alike share one of the rarest fifth of either's shingles, so only those are joined.
p AS (SELECT doc_id, sh FROM (SELECT doc_id, sh, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, sh) AS r
      FROM s JOIN f USING (sh) JOIN n USING (doc_id)) WHERE r <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.sh = y.sh AND x.doc_id < y.doc_id),
i AS (SELECT a, b, count(*) AS k FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.sh = x.sh GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
g AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query(_SQL)
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.find(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))
