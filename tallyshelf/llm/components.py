"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.session import settle


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id that is in a link (a, b); component is the least id reachable.

    Large and small stars in turn: an id hands its larger neighbours, then its smaller ones, to the least
    of them, until nothing changes. A hub's neighbours are never gathered: their least is aggregated and
    joined back, and Spark splits that join where one id has very many. Each round is a written table, so
    a lost executor costs no earlier round. The rounds grow with the logarithm of the largest component.
    """
    stars = settle(_turned(links.filter("a <> b")))
    state = None
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(
            "u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = settle(_turned(small.unionAll(least).toDF("a", "b")))
        now = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
