"""Query of the phrase mining, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyshelf.llm import collocations
from tallyshelf.llm.common import table
from tallyshelf.llm.registry import query

_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f
      FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
            FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f FROM g WHERE m > 1 AND f >= 100),
x AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, (1000 * c.f * n.n) // (l.f * r.f) AS score,
        row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * c.f * n.n) // (l.f * r.f), k) AS nth
      FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c) c
      JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[:k], ' ')
      JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')
      JOIN n ON n.lang = c.lang),
y AS (SELECT * FROM x WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = x.lang AND 100 * c.f >= 100 * x.a
      AND length(c.phrase) > length(x.phrase) AND contains(' ' || c.phrase || ' ', ' ' || x.phrase || ' ')))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM y) WHERE rank <= 2000
"""


@query(_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(*collocations.frequent_phrases(table(spark, sf_dir, "documents").select("text", "lang")))
