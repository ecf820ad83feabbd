"""Catalogue-shaped tables derived from the given ones, whole and row by row.

Suppliers stand for shops, order lines for items, events for snapshots of stock and for user logs.
Every column is a plain function of the source row, stated once for Spark here and once for the
checking SQL below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions import classify, geo
from tallyshelf.functions.price import pack_grams

COUNTRIES = ["JP", "NO", "US", "GB", "AU", "DE", "KR", "TW", "CA", "SE", "FR", "IT", "NL", "DK", "ID", "TH", "IN",
             "BR", "CO", "MX", "AE", "ZA", "NZ", "FI", "CH"]
CURRENCIES = ["JPY", "USD", "EUR", "NOK", "GBP", "KRW", "XXX"]
PRICE_SCALES = [20.0, 3000.0, 3300.0, 300.0, 4000.0, 4000.0, 20.0]
STYLES = ["極浅煎り", "浅煎り", "浅煎り〜中煎り", "中深煎り", "—"]
TAILS = ["Geisha Natural", "Sidra Anaerobic", "COE #3 Lot", "Cup of Excellence 12th place", "Cerro Azul Colombia",
         "House Blend Geisha", "Washed 250g", "Cold Brew Pack", "1kg Washed", "CGLE Honey", "Ceramic Mug",
         "Jasmine Peach"]
ORIGINS = ["エチオピア", "ケニア", "コロンビア", "パナマ", "ブラジル", "インドネシア", "ブレンド", "グアテマラ",
           "インド", "ルワンダ", "", "台湾"]
PROCESSES = ["Washed", "Natural", "Honey", "Anaerobic Natural", "Anaerobic Washed", "Anaerobic",
             "Carbonic Maceration", ""]
PACKS = ["100g", "250g", "12oz", "200g"]
NOTES = ["Jasmine, bergamot, peach", "Chocolate and hazelnut", "blackcurrant, rum, winey", "", "2050", "lime"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A given table dealt over all cores: its file is one row group, which one task would read and work on alone."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def choose(values: list, index: Column) -> Column:
    """Entry of a short fixed list by an index expression, taken modulo its length."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city"))
    country = choose(COUNTRIES, F.col("s_nationkey"))
    return s.join(n, "s_nationkey").select(
        F.concat(F.lit("s"), key).alias("shop"),
        F.concat(F.lit("Shop "), key, F.lit(" Coffee Roasters")).alias("name"),
        "city", country.alias("country"), geo.region_of(country).alias("region"),
        F.when(key % 10 == 3, "").otherwise(F.concat(F.lit("shop"), key, F.lit(".example.com"))).alias("url"),
        F.when(key % 2 == 0, "Shopify").otherwise("BASE").alias("platform"),
        choose(STYLES, key).alias("style"),
        choose(CURRENCIES, F.col("s_nationkey")).alias("cur"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = dealt(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus",
        "l_shipdate"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    order, number, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    amount = F.floor(F.col("l_extendedprice") / choose(PRICE_SCALES, F.col("s_nationkey"))).cast("double")
    pack = choose(PACKS, number)
    return line.join(part, "l_partkey").join(sup, "l_suppkey").select(
        F.concat_ws("-", order, number, p, "l_suppkey").alias("id"), (order * 8 + number).alias("seq"),
        F.concat(F.lit("s"), "l_suppkey").alias("shop"),
        F.concat_ws(" ", "p_name", choose(TAILS, order + number)).alias("name"),
        choose(ORIGINS, p).alias("origin"), choose(PROCESSES, order).alias("process"),
        F.when(p % 50 == 0, 0.0).otherwise(amount).alias("amount"),
        choose(CURRENCIES, F.col("s_nationkey")).alias("cur"), pack.alias("per"), pack_grams(pack).alias("grams"),
        F.when(F.col("l_linestatus") == "O", "now").when(F.col("l_returnflag") == "R", "sold").otherwise("archive")
        .alias("status"),
        F.when(order % 97 != 0, F.col("l_shipdate").cast("date")).alias("updated_at"),
        choose(NOTES, p + number).alias("notes"), F.lit("").alias("tags"),
        F.when(order % 2 == 0, F.concat(F.lit("https://shop"), "l_suppkey", F.lit(".example.com/p/"), order))
        .alias("link"),
    )


def flagged(items_: DataFrame) -> DataFrame:
    """Items with variety, award, award_rank and estate."""
    award = classify.is_award(F.col("name"))
    return items_.select(
        "*", classify.variety(F.col("name"), F.col("tags")).alias("variety"), award.alias("award"),
        F.when(award, classify.award_rank(F.col("name"))).alias("award_rank"),
        classify.is_estate(F.col("name"), F.col("origin")).alias("estate"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock observations: an error event means the key is out of stock at that time."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), "ts", (F.col("event_type") != "error").alias("available"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User log: every event is a rating of some item of the part table, in some shop of the supplier table."""
    e = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts"))
    part, shop = (1 + F.pmod("event_id", F.lit(table(spark, sf_dir, name).count())) for name in ("part", "supplier"))
    return e.select(
        F.col("user_id").alias("user"), part.alias("item_id"), F.concat(F.lit("s"), shop).alias("shop"),
        F.when(F.col("event_id") % 5 == 0, choose(ORIGINS, F.col("event_id"))).alias("origin"),
        (F.floor("value").cast("int") % 6).alias("rating"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "ts",
        F.col("event_id"),
    )


def rated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table as the items a log refers to."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.concat(F.lit("s"), 1 + F.pmod(key, F.lit(table(spark, sf_dir, "supplier").count()))).alias("shop"), F.col("p_name").alias("name"),
        choose(ORIGINS, key).alias("origin"), choose(PROCESSES, key).alias("process"),
        F.when(key % 9 == 0, "geisha").alias("variety"), choose(["berry", "citrus", "choco"], key).alias("family"),
        F.col("p_retailprice").alias("amount"), F.lit("JPY").alias("cur"), F.col("p_retailprice").alias("yen"),
        F.when(key % 3 == 0, "sold").otherwise("now").alias("status"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as items in the flavour plane."""
    e, key = F.col("embedding"), F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        key.alias("id"), choose(["エチオピア", "ケニア", "ブレンド", "コロンビア", ""], F.col("label")).alias("origin"),
        F.concat(F.lit("s"), F.pmod(key, F.lit(7))).alias("shop"),
        choose(["berry", "tropical", "floral", "citrus", "choco"], F.col("label") + key).alias("family"),
        (e[0].cast("double") * 100 + 50).alias("x"), (e[1].cast("double") * 100 + 50).alias("y"),
        F.when(key % 11 == 0, 0.0).otherwise(F.abs(e[2].cast("double")) * 20000 + 300).alias("p100"),
    )


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + "]"


def _pick(values: list, index: str) -> str:
    return f"{_list(values)}[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def _sql_map(table_: dict, key: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table_.items())
    return f"CASE {key} {whens} END"


def sql_shops() -> str:
    from tallyshelf.functions import rules

    regions = " ".join(
        "WHEN {} THEN '{}'".format(f"country IN ({', '.join(repr(c) for c in codes)})", region)
        for region, codes in rules.REGION_COUNTRIES.items())
    return f"""shops AS (
      SELECT *, CASE {regions} ELSE 'europe' END AS region FROM (
        SELECT 's' || s_suppkey AS shop, 'Shop ' || s_suppkey || ' Coffee Roasters' AS name, n_name AS city,
          {_pick(COUNTRIES, 's_nationkey')} AS country,
          CASE WHEN s_suppkey % 10 = 3 THEN '' ELSE 'shop' || s_suppkey || '.example.com' END AS url,
          CASE WHEN s_suppkey % 2 = 0 THEN 'Shopify' ELSE 'BASE' END AS platform,
          {_pick(STYLES, 's_suppkey')} AS style, {_pick(CURRENCIES, 's_nationkey')} AS cur
        FROM supplier JOIN nation ON s_nationkey = n_nationkey))"""


def sql_items() -> str:
    from tallyshelf.functions import rules

    rate = _sql_map({k: float(v) for k, v in rules.YEN_RATES.items()}, "cur")
    name = "name"
    return f"""raw_items AS (
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey * 8 + l_linenumber AS seq,
        's' || l_suppkey AS shop, p_name || ' ' || {_pick(TAILS, 'l_orderkey + l_linenumber')} AS name,
        {_pick(ORIGINS, 'l_partkey')} AS origin, {_pick(PROCESSES, 'l_orderkey')} AS process,
        CASE WHEN l_partkey % 50 = 0 THEN 0.0
          ELSE floor(l_extendedprice / {_pick(PRICE_SCALES, 's_nationkey')}::DOUBLE) END::DOUBLE AS amount,
        {_pick(CURRENCIES, 's_nationkey')} AS cur, {_pick(PACKS, 'l_linenumber')} AS per,
        {_pick([100, 250, 340, 200], 'l_linenumber')} AS grams,
        CASE WHEN l_linestatus = 'O' THEN 'now' WHEN l_returnflag = 'R' THEN 'sold' ELSE 'archive' END AS status,
        CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) END AS updated_at,
        {_pick(NOTES, 'l_partkey + l_linenumber')} AS notes,
        CASE WHEN l_orderkey % 2 = 0 THEN 'https://shop' || l_suppkey || '.example.com/p/' || l_orderkey END AS link
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
    items AS (
      SELECT *, amount * rate AS yen, amount * rate / grams * 100 AS p100,
        CASE WHEN regexp_matches({name}, '(?i)\\bblend\\b') THEN NULL WHEN regexp_matches({name}, '(?i)\\bsidra\\b') THEN 'sidra'
          WHEN regexp_matches({name}, '(?i)\\b(geisha|gesha)\\b') THEN 'geisha' END AS variety,
        regexp_matches({name}, '(?i)\\bCOE\\b|cup\\s*of\\s*excellence') AS award,
        regexp_matches({name}, '(?i)\\bCGLE\\b') OR (regexp_matches({name}, '(?i)cerro\\s*azul')
          AND (origin = 'コロンビア' OR regexp_matches({name}, '(?i)colombia'))) AS estate,
        CASE WHEN regexp_matches(process, '(?i)Anaerobic\\s*Natural') THEN 'anatural'
          WHEN regexp_matches(process, '(?i)Anaerobic\\s*Washed') THEN 'awashed'
          WHEN regexp_matches(process, '(?i)Anaerobic') THEN 'anatural' WHEN regexp_matches(process, '(?i)Honey') THEN 'honey'
          WHEN regexp_matches(process, '(?i)Natural') THEN 'natural' WHEN regexp_matches(process, '(?i)Washed') THEN 'washed'
          ELSE 'other' END AS process_class,
        CASE WHEN regexp_matches(origin, 'エチオピア|ケニア|ルワンダ|ブルンジ|タンザニア') THEN 'africa'
          WHEN regexp_matches(origin, 'コロンビア|ブラジル|グアテマラ|パナマ|ペルー') THEN 'latam'
          WHEN regexp_matches(origin, 'インドネシア|インド|中国|タイ') THEN 'asia' END AS origin_group
      FROM (SELECT *, {rate} AS rate FROM raw_items))"""


SQL_BUYABLE = "buyable AS (SELECT i.* FROM items i JOIN shops s USING (shop) WHERE i.status = 'now' AND s.url <> '')"
SQL_SNAPSHOTS = "snap AS (SELECT user_id AS key, ts, event_type <> 'error' AS available FROM events)"
