"""Catalogue queries: filters, listings, counts, prices, flavour coordinates, rates."""

from __future__ import annotations

import posixpath
import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyshelf.functions import flavour, price, rules
from tallyshelf.functions.classify import process_class
from tallyshelf.operators import catalogue, dims, pages, profile
from tallyshelf.plans.publish import locate
from tallyshelf.session import delete_later, ensure_checkpoint_dir, settle
from tallyshelf.sources import dims as dim_sources
from workload import standins as S
from workload.registry import query, with_

BASE = (S.sql_items(), S.sql_shops())


def priced(spark, sf, default_rate=None):
    return catalogue.with_unit_price(S.items(spark, sf), default_rate)


@query(with_(*BASE, body="""SELECT i.id, i.shop, s.name AS shop_name, s.country AS shop_country, i.yen FROM items i JOIN shops s USING (shop)
  WHERE s.url <> '' AND i.origin = 'エチオピア' AND i.status <> 'sold' AND i.process_class = 'natural' AND i.yen >= 2000 AND i.yen < 3000
    AND (lower(i.name) LIKE '%red%' OR lower(s.name) LIKE '%red%' OR lower(s.country) LIKE '%red%')"""))
def catalogue_filter(spark, sf):
    rows = catalogue.filter_items(priced(spark, sf), S.shops(spark, sf), query=" Red ", origin="エチオピア", process="Natural",
                                  price="mid")
    return rows.select("id", "shop", "shop_name", "shop_country", "yen")


@query(with_(*BASE, body="""SELECT i.id, i.status, s.country AS shop_country FROM items i JOIN shops s USING (shop) WHERE s.url <> ''
  AND i.status = 'now' AND i.yen < 2000 AND (lower(i.name) LIKE '%jp%' OR lower(s.name) LIKE '%jp%' OR lower(s.country) LIKE '%jp%')"""))
def catalogue_country_search(spark, sf):
    rows = catalogue.filter_items(priced(spark, sf), S.shops(spark, sf), query="jp", status="now", price="low")
    return rows.select("id", "status", "shop_country")


SQL_OK = "coalesce(p100 BETWEEN 100 AND 150000, false)"


@query(with_(*BASE, body=f"""SELECT id, round(p100, 6) AS p100 FROM items ORDER BY {SQL_OK} DESC, p100 ASC NULLS LAST, seq, id LIMIT 100 OFFSET 200"""))
def cheapest_page(spark, sf):
    order = catalogue.by_unit_price(True, tie=("seq", "id"))
    return catalogue.page(priced(spark, sf), order, 2, 100).select("id", F.round("p100", 6).alias("p100"))


@query(with_(*BASE, body=f"""SELECT id, round(p100, 6) AS p100 FROM items ORDER BY {SQL_OK} DESC, p100 DESC NULLS LAST, seq, id LIMIT 100"""))
def dearest_page(spark, sf):
    order = catalogue.by_unit_price(False, tie=("seq", "id"))
    return catalogue.page(priced(spark, sf), order, 0, 100).select("id", F.round("p100", 6).alias("p100"))


@query(with_(*BASE, body="""SELECT id, CAST(updated_at AS VARCHAR) AS updated_at FROM items ORDER BY items.updated_at DESC NULLS LAST, seq DESC, id DESC LIMIT 100"""))
def newest_page(spark, sf):
    order = catalogue.by_date(False, tie=("seq", "id"))
    return catalogue.page(S.items(spark, sf), order, 0, 100).select("id", F.col("updated_at").cast("string").alias("updated_at"))


@query(with_(*BASE, body="""SELECT id, CAST(updated_at AS VARCHAR) AS updated_at FROM items ORDER BY items.updated_at ASC NULLS LAST, seq, id LIMIT 100"""))
def oldest_page(spark, sf):
    order = catalogue.by_date(True, tie=("seq", "id"))
    return catalogue.page(S.items(spark, sf), order, 0, 100).select("id", F.col("updated_at").cast("string").alias("updated_at"))


@query(with_(*BASE, f"""listed AS (SELECT id, row_number() OVER (ORDER BY {SQL_OK} DESC, p100 ASC NULLS LAST, seq, id) - 1 AS n, count(*) OVER () AS total FROM items)""",
             body="""SELECT page, n - least(page, (total - 1) // 100) * 100 + 1 AS place, id FROM listed, (SELECT unnest([0, 7, 40, 1000000]) AS page)
  WHERE n // 100 = least(page, (total - 1) // 100)"""))
def listing_pages(spark, sf):
    """The whole listing written in order, and pages of it read by number; one past the end is the last."""
    path = delete_later(posixpath.join(ensure_checkpoint_dir(spark), f"pages-{uuid.uuid4().hex}"))
    pages.write_pages(priced(spark, sf).select("id", "seq", "p100"), catalogue.by_unit_price(True, tie=("seq", "id")), path, file_rows=20_000)
    listing = pages.Pages(spark, path, 100)
    found = [listing.read(n).select(F.lit(n).alias("page"), F.monotonically_increasing_id().alias("place"), "id") for n in (0, 7, 40, 1_000_000)]
    rows = reduce(lambda a, b: a.unionAll(b), found)
    return rows.select("page", F.row_number().over(Window.partitionBy("page").orderBy("place")).cast("bigint").alias("place"), "id")


@query(with_(*BASE, body="""SELECT s.shop, s.name, count(i.id) AS n_now FROM shops s LEFT JOIN items i ON i.shop = s.shop AND i.status = 'now'
  WHERE lower(s.name) LIKE '%shop 1%' OR lower(s.city) LIKE '%shop 1%' OR lower(s.country) LIKE '%shop 1%' GROUP BY 1, 2"""))
def shop_list(spark, sf):
    return catalogue.filter_shops(S.shops(spark, sf), S.items(spark, sf), "shop 1").select("shop", "name", "n_now")


@query(with_(*BASE, body="""SELECT shop, count(*) FILTER (status = 'now') AS n_now, count(*) FILTER (status = 'sold') AS n_sold,
  count(*) FILTER (status = 'archive') AS n_archive FROM items GROUP BY shop"""))
def status_counts(spark, sf):
    return catalogue.status_counts(S.items(spark, sf))


@query(with_(*BASE, body="""SELECT shop, coalesce(year(updated_at), 0) AS year, count(*) AS n FROM items WHERE status = 'archive' GROUP BY 1, 2"""))
def archive_years(spark, sf):
    return catalogue.archive_years(S.items(spark, sf)).withColumn("year", F.coalesce("year", F.lit(0)))


@query(with_(*BASE, S.SQL_BUYABLE, """bands AS (SELECT * FROM (VALUES ('<1000', 0, 1000), ('1000-2000', 1000, 2000), ('2000-3000', 2000, 3000),
    ('3000-5000', 3000, 5000), ('>=5000', 5000, NULL)) t(name, low, high))""", body="""
  SELECT 'total' AS section, 'shops' AS name, count(*) AS n FROM shops WHERE url <> ''
  UNION ALL SELECT 'total', 'countries', count(DISTINCT country) FROM shops WHERE url <> ''
  UNION ALL SELECT 'region', region, count(*) FROM shops WHERE url <> '' GROUP BY region
  UNION ALL SELECT 'total', 'now', count(*) FROM buyable
  UNION ALL SELECT 'total', 'origins', count(DISTINCT origin) FROM buyable WHERE origin NOT IN ('', 'ブレンド')
  UNION ALL SELECT 'total', 'notes', count(*) FROM buyable WHERE notes <> ''
  UNION ALL SELECT 'total', 'priced', count(*) FROM buyable WHERE amount > 0
  UNION ALL SELECT 'process', process_class, count(*) FROM buyable GROUP BY 2
  UNION ALL SELECT 'band', b.name, count(i.id) FROM bands b LEFT JOIN buyable i ON i.amount > 0 AND i.p100 >= b.low
    AND (b.high IS NULL OR i.p100 < b.high) GROUP BY 2"""))
def overview(spark, sf):
    return catalogue.overview(priced(spark, sf), S.shops(spark, sf))


@query(with_(*BASE, S.SQL_BUYABLE, body="""SELECT process_class, count(*) AS n, round(avg(p100), 4) AS mean_p100,
  round(count(*) / sum(count(*)) OVER (), 8) AS share FROM buyable GROUP BY process_class"""))
def process_stats(spark, sf):
    return catalogue.process_stats(priced(spark, sf), S.shops(spark, sf)).select(
        "process_class", "n", F.round("mean_p100", 4).alias("mean_p100"), F.round("share", 8).alias("share"))


@query(with_(*BASE, S.SQL_BUYABLE, body="""SELECT id, round(p100, 6) AS p100 FROM buyable WHERE process_class = 'honey'
  """))
def process_listing(spark, sf):
    rows = catalogue.process_listing(priced(spark, sf), S.shops(spark, sf), "honey")
    return rows.select("id", F.round("p100", 6).alias("p100"))


_HITS = {name: (fy, fx) for name, fy, fx, _ in rules.FLAVOUR_FAMILIES}


def _sql_families(text: str) -> str:
    """Distinct vocabulary hits per family; the driver's SQL engine has no look-around, but \\b does."""
    parts = []
    for name, _, _, pattern in rules.FLAVOUR_FAMILIES:
        parts.append(f"len(list_distinct(regexp_extract_all(lower({text}), '{pattern}'))) AS {name}")
    return ", ".join(parts)


def _sql_located() -> str:
    fams = flavour.FAMILIES
    hits = "+".join(fams)
    top = "CASE " + " ".join(f"WHEN {f} = greatest({', '.join(fams)}) THEN '{f}'" for f in fams) + " END"
    wx = "+".join(f"{f}*{fx}.0" for f, (fy, fx) in _HITS.items())
    wy = "+".join(f"{f}*{fy}.0" for f, (fy, fx) in _HITS.items())
    spread = "+".join(f"({f} > 0)::INT" for f in fams)
    funk = f"len(list_distinct(regexp_extract_all(lower(name || ' ' || notes), '{rules.FERMENT_WORDS}')))"
    ox = "CASE nfam " + " ".join(f"WHEN '{f}' THEN {fx}" for f, (_, fx) in _HITS.items()) + " ELSE 0 END"
    oy = "CASE nfam " + " ".join(f"WHEN '{f}' THEN {fy}" for f, (fy, _) in _HITS.items()) + " ELSE 0 END"
    return f"""scored AS (SELECT *, {_sql_families("CASE WHEN notes <> '' THEN name || ' ' || notes ELSE name END")},
        {funk} AS funk FROM items),
      byname AS (SELECT *, {_sql_families('name').replace(' AS ', ' AS n_')} FROM scored),
      w AS (SELECT *, {hits} AS hits, CASE WHEN greatest({', '.join('n_' + f for f in fams)}) = 0 THEN NULL ELSE
        CASE {' '.join(f"WHEN n_{f} = greatest({', '.join('n_' + g for g in fams)}) THEN '{f}'" for f in fams)} END END AS nfam,
        {top} AS tfam, CASE WHEN {spread} >= 3 THEN 0.5 ELSE 0.25 END::DOUBLE AS amp, {wx} AS wx, {wy} AS wy,
        ((seq % 21) * 53) % 21 - 10 AS jx, ((seq % 21) * 97) % 21 - 10 AS jy,
        regexp_matches(process, 'Natural|Anaerobic') AS wild FROM byname),
      g AS (SELECT *, notes <> '' AND hits > 0 AS noted,
        CASE WHEN process LIKE '%Anaerobic%' THEN 84 WHEN process LIKE '%Natural%' THEN 66 WHEN process LIKE '%Honey%' THEN 54 ELSE 30 END AS bx,
        CASE WHEN regexp_matches(origin, 'エチオピア|ケニア|ルワンダ') THEN 24 WHEN regexp_matches(origin, 'コロンビア|グアテマラ|パナマ') THEN 42
          WHEN regexp_matches(origin, 'ブラジル|インドネシア|インド') THEN 72 WHEN origin = 'ブレンド' THEN 62 ELSE 48 END AS by_,
        CASE WHEN origin = 'エチオピア' THEN CASE WHEN wild THEN 'berry' ELSE 'floral' END WHEN origin = 'ケニア' THEN 'berry'
          WHEN origin IN ('コロンビア', 'グアテマラ', 'パナマ') THEN 'citrus' WHEN origin IN ('ブラジル', 'インドネシア', 'インド') THEN 'choco'
          WHEN wild THEN 'tropical' ELSE 'citrus' END AS gfam FROM w),
      located AS (SELECT *, CASE WHEN noted THEN 'notes' ELSE 'guess' END AS source,
        CASE WHEN noted THEN tfam ELSE coalesce(nfam, gfam) END AS family,
        greatest(4, least(96, CASE WHEN noted THEN 50 + wx / hits * 2.2::DOUBLE + least(3, funk) * 9 + jx * amp ELSE bx + {ox} + jx * 0.9::DOUBLE END)) AS x,
        greatest(4, least(96, CASE WHEN noted THEN 50 + wy / hits * 2.2::DOUBLE + jy * amp ELSE by_ + {oy} + jy * 0.9::DOUBLE END)) AS y FROM g)"""


@query(with_(*BASE, _sql_located(), body="SELECT id, round(x, 6) AS x, round(y, 6) AS y, family, source FROM located"))
def flavour_points(spark, sf):
    return locate(S.items(spark, sf), "seq").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "family", "source")


@query(with_(*BASE, _sql_located(), body="""SELECT id, process_class, family FROM located JOIN shops USING (shop)
  WHERE status = 'now' AND url <> '' AND source = 'notes' AND process_class = 'anatural'"""))
def map_selection(spark, sf):
    located = locate(S.items(spark, sf), "seq")
    return catalogue.map_points(located, S.shops(spark, sf), "anatural", notes_only=True).select("id", "process_class", "family")


@query(with_(*BASE, _sql_located(), """pts AS (SELECT process_class, x, y, row_number() OVER (PARTITION BY process_class ORDER BY x) - 1 AS rx,
    row_number() OVER (PARTITION BY process_class ORDER BY y) - 1 AS ry, count(*) OVER (PARTITION BY process_class) AS n
    FROM located JOIN shops USING (shop) WHERE status = 'now' AND url <> '')""", body="""
  SELECT process_class, n, CAST(floor(max(x) FILTER (rx = n // 2) + 0.5) AS BIGINT) AS med_x,
    CAST(floor(max(y) FILTER (ry = n // 2) + 0.5) AS BIGINT) AS med_y FROM pts GROUP BY process_class, n"""))
def process_medians(spark, sf):
    located = locate(S.items(spark, sf), "seq")
    return catalogue.coordinate_medians(catalogue.map_points(located, S.shops(spark, sf)))


@query(with_(*BASE, S.SQL_BUYABLE, """lots AS (SELECT *, unnest(list_filter([CASE WHEN variety = 'geisha' THEN 'geisha' END,
    CASE WHEN variety = 'sidra' THEN 'sidra' END, CASE WHEN award THEN 'award' END, CASE WHEN estate THEN 'estate' END],
    lambda c: c IS NOT NULL)) AS category FROM buyable WHERE amount > 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY coalesce(p100 >= 1, false) DESC, p100 ASC NULLS LAST, id) AS place,
    count(*) OVER (PARTITION BY category) AS n_category FROM lots)""", body="""
  SELECT category, place, id, n_category, greatest(0, n_category - 10) AS locked FROM ranked WHERE place <= 10"""))
def rare_ladder(spark, sf):
    items = catalogue.with_unit_price(S.flagged(S.items(spark, sf)))
    return catalogue.rare_ladder(items, S.shops(spark, sf)).select("category", F.col("place").cast("bigint").alias("place"), "id",
                                                                    "n_category", "locked")


@query(with_(*BASE, """v AS (SELECT shop, amount * coalesce(rate, 1) / grams * 100 AS p FROM items WHERE amount > 0 AND status = 'now'),
  o AS (SELECT shop, p, row_number() OVER (PARTITION BY shop ORDER BY p) - 1 AS r, count(*) OVER (PARTITION BY shop) AS n FROM v),
  st AS (SELECT shop, n, max(p) FILTER (r = n // 10) AS lo_end, max(p) FILTER (r = n - 1 - n // 10) AS hi_end,
    max(p) FILTER (r = n // 2) AS mid FROM o GROUP BY shop, n)""", body="""
  SELECT shop, n, round(lo_end, 6) AS lo_end, round(hi_end, 6) AS hi_end, round(mid, 6) AS mid FROM st
    WHERE n >= 3 AND (lo_end > 400 OR hi_end < 2000)"""))
def odd_prices(spark, sf):
    items = priced(spark, sf, default_rate=1).filter((F.col("amount") > 0) & (F.col("status") == "now"))
    odd = profile.odd_prices(items, low=2000, high=400)
    return odd.select("shop", "n", *[F.round(c, 6).alias(c) for c in ("lo_end", "hi_end", "mid")])


@query(with_(*BASE, body="""SELECT id, CASE WHEN yen IS NULL THEN '' ELSE '¥' || format('{:,}', CAST(floor(yen + 0.5) AS BIGINT)) END AS yen,
  CASE WHEN yen IS NULL THEN '' ELSE '$' || printf('%.2f', yen / 150) END AS usd, coalesce(CASE cur WHEN 'JPY' THEN '¥' WHEN 'USD' THEN '$' WHEN 'EUR'
    THEN '€' WHEN 'NOK' THEN 'kr ' WHEN 'GBP' THEN '£' WHEN 'KRW' THEN '₩' END, '') || format('{:,}', CAST(amount AS BIGINT))
    || CASE WHEN cur IN ('JPY', 'USD') THEN '' ELSE ' ' || cur END AS local FROM items"""))
def money_text(spark, sf):
    rows = priced(spark, sf)
    yen = F.col("yen")
    return rows.select("id", F.coalesce(price.format_yen(yen), F.lit("")).alias("yen"),
                       F.coalesce(price.format_yen(yen, "USD"), F.lit("")).alias("usd"),
                       price.format_local(F.col("amount"), F.col("cur")).alias("local"))


def _rates(spark, sf):
    """A rate per currency for some days: every supplier quotes its currency once."""
    s, key = S.table(spark, sf, "supplier"), F.col("s_suppkey")
    return s.select(S.choose(S.CURRENCIES, F.col("s_nationkey")).alias("cur"),
                    F.date_add(F.lit("1995-06-01").cast("date"), F.pmod(key * 37, F.lit(2000)).cast("int")).alias("rate_date"),
                    (F.col("s_acctbal") + 2000).alias("jpy"))


@query(f"""WITH rates AS (SELECT cur, rate_date, max(jpy) AS jpy FROM (SELECT {S._pick(S.CURRENCIES, 's_nationkey')} AS cur,
    CAST(DATE '1995-06-01' + CAST((s_suppkey * 37) % 2000 AS INTEGER) AS DATE) AS rate_date, s_acctbal + 2000 AS jpy FROM supplier) GROUP BY 1, 2),
  prices AS (SELECT o_orderkey, {S._pick(S.CURRENCIES, 'o_custkey')} AS cur, CAST(o_orderdate AS DATE) AS at FROM orders)
  SELECT p.o_orderkey, p.cur, r.jpy FROM prices p ASOF LEFT JOIN rates r ON p.cur = r.cur AND p.at >= r.rate_date""")
def fx_as_of(spark, sf):
    prices = S.table(spark, sf, "orders").select("o_orderkey", S.choose(S.CURRENCIES, F.col("o_custkey")).alias("cur"),
                                                 F.col("o_orderdate").cast("date").alias("at"))
    return catalogue.rates_as_of(prices, _rates(spark, sf)).select("o_orderkey", "cur", "jpy")


SQL_LIVE = ", ".join(f"'{c}'" for c in rules.LIVE_RATE_CURRENCIES)


@query(f"""WITH p AS (SELECT n_regionkey % 2 AS priority, {S._pick(S.CURRENCIES, 'n_nationkey')} AS cur, n_nationkey / 100.0::DOUBLE AS units FROM nation),
  ok AS (SELECT * FROM p WHERE units > 0 AND cur IN ({SQL_LIVE})),
  live AS (SELECT cur, max(1 / units) AS v FROM ok WHERE priority = (SELECT min(priority) FROM ok) GROUP BY cur),
  d AS (SELECT DISTINCT {S._pick(S.CURRENCIES, 's_nationkey')} AS cur, 7.0::DOUBLE AS jpy FROM supplier)
  SELECT coalesce(d.cur, live.cur) AS cur, round(coalesce(v, jpy), 9) AS jpy FROM d FULL JOIN live ON d.cur = live.cur""")
def latest_rates(spark, sf):
    key = F.col("n_nationkey")
    quotes = S.table(spark, sf, "nation").select((F.col("n_regionkey") % 2).alias("priority"), S.choose(S.CURRENCIES, key).alias("cur"),
                                                 (key / 100.0).alias("units"))
    payloads = quotes.select("priority", F.create_map("cur", "units").alias("rates"))
    defaults = S.table(spark, sf, "supplier").select(S.choose(S.CURRENCIES, F.col("s_nationkey")).alias("cur")).distinct()
    rates = dims.latest_rates(payloads, defaults.withColumn("jpy", F.lit(7.0)))
    return rates.select("cur", F.round("jpy", 9).alias("jpy"))


@query("""WITH s AS (SELECT c_custkey AS shop, round(c_acctbal, 2) AS balance, CASE WHEN c_custkey % 3 <> 2 THEN 'JPY' ELSE '' END AS home,
    CASE WHEN c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND c_custkey % 5 <> 0) THEN 'USD' ELSE '' END AS shown FROM customer),
  t AS (SELECT *, shop % 2 = 0 AND shop % 11 <> 0 AND shop % 13 <> 0 AND shop % 17 <> 0 AND balance <> round(balance * 150, 2) AS took FROM s)
  SELECT shop, CASE WHEN home <> '' AND shown <> '' AND home <> shown THEN CASE WHEN took THEN home ELSE shown END
    WHEN home <> '' THEN home WHEN shown <> '' THEN shown ELSE 'EUR' END AS currency FROM t""")
def presentment_currency(spark, sf):
    """Payloads of every customer as a shop: some ignore the asked currency, some are cut off, empty or missing."""
    s = F.col("shop")
    base = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("shop"), F.col("c_acctbal").alias("balance"))
    shops = base.select("shop", F.when(s % 3 != 2, "JPY").otherwise("").alias("home"),
                        F.when((s % 3 == 0) | ((s % 3 == 2) & (s % 5 != 0)), "USD").otherwise("").alias("presentment"),
                        F.lit("EUR").alias("configured"))

    def payload(price):
        variant = F.struct(F.format_string("%.2f", price).alias("price"))
        goods = F.array(F.struct(F.lit("p").alias("handle"), F.array(variant, F.struct(F.lit("7").alias("price"))).alias("variants")))
        text = F.to_json(F.struct(F.when(s % 13 == 0, F.slice(goods, 1, 0)).otherwise(goods).alias("products")))
        return F.when(s % 11 == 0, F.substring(text, 1, 20)).otherwise(text).alias("body")

    plain = base.select("shop", payload(F.round("balance", 2)))
    asked = base.filter(s % 17 != 0).select("shop", payload(F.when(s % 2 == 0, F.round(F.col("balance") * 150, 2)).otherwise(F.round("balance", 2))))
    return dims.presentment_currency(dims.first_prices(plain), dims.first_prices(asked), shops)


SQL_UNITS = f"""units AS (SELECT {S._pick(S.CURRENCIES, 's_nationkey')} AS cur, count(*) / 1000.0::DOUBLE AS units FROM supplier GROUP BY 1)"""


@query(f"""WITH {SQL_UNITS} SELECT cur, round(CASE WHEN cur IN ('USD', 'EUR', 'NOK', 'GBP', 'KRW') THEN 1 / units ELSE 7.0 END, 9) AS jpy,
  CASE WHEN cur IN ('USD', 'EUR', 'NOK', 'GBP', 'KRW') THEN '2024-02-02' ELSE '' END AS rate_date FROM units""")
def live_rates(spark, sf):
    """Payload texts of three sources: one cut off, one without a rate above zero, one with rates by supplier counts."""
    units = S.table(spark, sf, "supplier").groupBy(S.choose(S.CURRENCIES, F.col("s_nationkey")).alias("cur")).agg((F.count(F.lit(1)) / 1000).alias("u"))
    rates = F.map_from_entries(F.collect_list(F.struct("cur", "u")))
    good = units.agg(F.to_json(F.struct(F.lit("Fri, 02 Feb 2024 00:00:01 +0000").alias("time_last_update_utc"), rates.alias("rates"))).alias("value"))
    broken = units.agg(F.substring(F.to_json(F.struct(rates.alias("rates"))), 1, 25).alias("value"))
    zero = units.agg(F.to_json(F.struct(F.lit("2024-02-01").alias("date"), F.transform_values(rates, lambda k, v: -v).alias("rates"))).alias("value"))
    texts = [t.select(F.lit(i).alias("priority"), "value") for i, t in enumerate((broken, zero, good))]
    payloads = settle(dim_sources.rate_payloads(texts[0].unionAll(texts[1]).unionAll(texts[2])))
    rates = dims.latest_rates(payloads, units.select("cur", F.lit(7.0).alias("jpy")))
    live = payloads.filter(F.exists(F.map_values("rates"), lambda v: v > 0)).select(F.explode(F.map_keys("rates")).alias("cur"), "rate_date")
    live = live.filter(F.col("cur").isin(rules.LIVE_RATE_CURRENCIES))
    return rates.join(live, "cur", "left").select("cur", F.round("jpy", 9).alias("jpy"), F.coalesce(F.col("rate_date").cast("string"), F.lit("")).alias("rate_date"))


def _in_place(rows, n):
    """The first rows of an ordered listing, numbered as they come."""
    return rows.limit(n).withColumn("place", F.monotonically_increasing_id() + 1)


SQL_WASHED = "washed AS (SELECT i.id, i.p100, i.updated_at FROM items i JOIN shops s USING (shop) WHERE i.status = 'now' AND s.url <> '' AND i.process_class = 'washed')"


@query(with_(*BASE, SQL_WASHED, body="""SELECT id, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, id DESC) AS place FROM washed QUALIFY place <= 500"""))
def process_newest(spark, sf):
    return _in_place(catalogue.process_listing(priced(spark, sf), S.shops(spark, sf), "washed", by_price=False), 500).select("id", "place")


@query(with_(*BASE, SQL_WASHED, body="""SELECT id, row_number() OVER (ORDER BY p100 NULLS LAST, id) AS place FROM washed QUALIFY place <= 500"""))
def process_cheapest(spark, sf):
    return _in_place(catalogue.process_listing(priced(spark, sf), S.shops(spark, sf), "washed"), 500).select("id", "place")


@query(with_(*BASE, S.SQL_BUYABLE, body="SELECT process_class, count(DISTINCT origin) AS n_origins FROM buyable GROUP BY 1"))
def processes_present(spark, sf):
    rows = catalogue.buyable(S.items(spark, sf), S.shops(spark, sf))
    return rows.groupBy(process_class(F.col("process")).alias("process_class")).agg(F.countDistinct("origin").alias("n_origins"))
