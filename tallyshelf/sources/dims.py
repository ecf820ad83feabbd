"""Dimension tables out of text and JSON files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.sinks.tables import product_state

# Fixed value: shape of a seed line.
SEED_LINE = (
    r'^\s+([A-Za-z0-9_]+): \{ name: "([^"]+)", city: "([^"]*)", country: "([^"]*)"'
    r'.*?coord: \[\s*(-?[\d.]+),\s*(-?[\d.]+)\s*\]'
)


def seed_shops(lines: DataFrame, column: str = "value") -> DataFrame:
    """Shops of a hand-written seed file, one per matching line: key, name, city, country, lon, lat."""
    def part(i: int):
        return F.regexp_extract(column, SEED_LINE, i)

    return lines.filter(F.col(column).rlike(SEED_LINE)).select(
        part(1).alias("key"), part(2).alias("name"), part(3).alias("city"), part(4).alias("country"),
        part(5).cast("double").alias("lon"), part(6).cast("double").alias("lat"),
    )


def read_seed_shops(spark: SparkSession, path: str) -> DataFrame:
    return seed_shops(spark.read.text(path))


def city_cache(texts: DataFrame, column: str = "value") -> DataFrame:
    """Cached city points: city_key, lon, lat, known.

    A key with null coordinates is known to be unknown, which differs from a missing key. A text
    that cannot be read gives no rows.
    """
    parsed = F.from_json(column, "map<string,array<double>>")
    return texts.select(F.explode(parsed).alias("city_key", "point")).select(
        "city_key", F.get("point", F.lit(0)).alias("lon"), F.get("point", F.lit(1)).alias("lat"),
        F.lit(True).alias("known"),
    )


def read_city_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache of a file; a missing file is an empty cache."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        texts = spark.createDataFrame([], "value string")
    return city_cache(texts)


def rate_payloads(texts: DataFrame, column: str = "value") -> DataFrame:
    """Landed rate payloads: priority, rates (units per yen), rate_date; ``texts`` has priority too."""
    parsed = F.from_json(column, "rates map<string,double>, date string, time_last_update_utc string")
    dated = F.coalesce(
        F.to_date(F.col("p.date")),
        F.try_to_timestamp(F.substring("p.time_last_update_utc", 6, 20), F.lit("dd MMM yyyy HH:mm:ss")).cast("date"),
    )
    return texts.select("priority", parsed.alias("p")).select("priority", F.col("p.rates").alias("rates"), dated.alias("rate_date"))


def shop_list(rows: list[dict], spark: SparkSession) -> DataFrame:
    """Shop list of a configuration with the place of each entry (the list is read on the driver)."""
    fields = ["name", "country", "url", "currency", "platform"]
    data = [(i, *[str(r.get(f) or "") for f in fields]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "idx INT, " + ", ".join(f"{f} STRING" for f in fields))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The whole product state, last seen first."""
    return newest_first(product_state(spark, path).read())


def newest_first(state: DataFrame) -> DataFrame:
    return state.orderBy(F.desc("last_seen"), "key")
