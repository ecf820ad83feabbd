"""Curation queries: goods rules, duplicates, caps, overlays, shop dimension, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyshelf.functions import classify, geo, goods, links, price, rules
from tallyshelf.functions.prefilter import alternatives
from tallyshelf.functions.status import first_seen_date, repair_first_seen
from tallyshelf.functions.text import grams_from_text, guess_origin, guess_process, shop_key, slug, title_key
from tallyshelf.operators import dims
from tallyshelf.plans import publish
from workload import standins as S
from workload.registry import query, with_


# Names that the two lists tell apart, and such that both reject or keep.
KINDS = ["", "AeroPress Go", "エプロン", "クッキー詰め合わせ", "Fellow Stagg EKG", "Barista Skills Foundation", "Oat Milk 1L", "豆乳", "Handwritten note",
         "Fellow Farms", "Love Notes", "Pink Bourbon", "Atelier Crenn Blend", "Cold Brew", "Wildcard", "teapot", "Ｔシャツ", "tea", "Earl Grey",
         "Watch list", "Watch", "Filters (100 Pack)", "Mahlkönig", "COE Mug", "Smagspakke", "FREE SHIPPING", "10-in-1", "70% dark chocolate"]
_LOOK_AHEAD = {r"\bwatch\b(?!\s*(list|ing))": (r"\bwatch\b", r"\bwatch\b\s*(list|ing)"), r"^atelier\b(?!.*blend)": (r"^atelier\b", r"^atelier\b.*blend")}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_listed(text: str, patterns) -> str:
    """A list as the checking engine's expression, which has no look-ahead; see the literal titles in the tests."""
    single = [a for p in patterns for a in alternatives(p)]
    plain = "|".join(f"(?:{p})" for p in single if "(?!" not in p).replace(r"\u00f6", "ö")
    rest = [f"(regexp_matches({text}, {_quoted(yes)}) AND NOT regexp_matches({text}, {_quoted(no)}))"
            for yes, no in (_LOOK_AHEAD[p] for p in single if "(?!" in p)]
    return " OR ".join([f"regexp_matches({text}, {_quoted(plain)})", *rest])


SQL_GOODS = f"""rules AS (SELECT id, name, grams, shop, status, seq,
  {_sql_listed("lower(name)", goods.FEED_EXCLUDED)} AS fed, {_sql_listed("lower(name)", goods.READER_EXCLUDED)} AS read,
  regexp_matches(name, '(?i)\\bCOE\\b|cup\\s*of\\s*excellence') AS award,
  coalesce(TRY_CAST(regexp_extract(name, '(?i)(\\d+(?:\\.\\d+)?)\\s?kg\\b', 1) AS DOUBLE) >= 1, false) AS kg,
  coalesce(TRY_CAST(regexp_extract(name, '(?i)(\\d+(?:\\.\\d+)?)\\s?lbs?\\b', 1) AS DOUBLE) >= 2, false) AS lb FROM named),
goods AS (SELECT *, (award OR NOT fed) AND grams < 1000 AND NOT kg AND NOT lb AS good FROM rules)"""
SQL_NAMED = ("named AS (SELECT * REPLACE (trim(name || ' ' || list_extract([" + ", ".join(map(_quoted, KINDS))
             + f"], (seq % {len(KINDS)} + 1)::INTEGER)) AS name) FROM items)")


def _named(spark, sf):
    """Items whose names go on with one of the kinds."""
    return S.items(spark, sf).withColumn("name", F.trim(F.concat_ws(" ", "name", S.choose(KINDS, F.col("seq")))))


@query(with_(S.sql_items(), SQL_NAMED, SQL_GOODS, body="""SELECT id, good AS is_product, award OR NOT read AS is_listed,
  grams >= 1000 OR kg OR lb OR regexp_matches(name, '(?i)wholesale|\\bbulk\\b') AS is_wholesale FROM goods"""))
def goods_rules(spark, sf):
    name, grams = F.col("name"), F.col("grams")
    return _named(spark, sf).select(
        "id", classify.is_product(name, grams).alias("is_product"), classify.is_listed_product(name).alias("is_listed"),
        classify.is_wholesale(name, grams).alias("is_wholesale"))


@query(with_(S.sql_items(), body="""SELECT id, award, estate, CASE WHEN award THEN
  CASE WHEN name LIKE '%#3 %' THEN 3.0 WHEN name LIKE '%12th place%' THEN 12.0 END END::DOUBLE AS award_rank, coalesce(variety, '') AS variety FROM items"""))
def rare_flags(spark, sf):
    rows = S.flagged(S.items(spark, sf))
    return rows.select("id", F.coalesce("variety", F.lit("")).alias("variety"), "award",
                       F.col("award_rank").cast("double").alias("award_rank"), "estate")


@query("""SELECT p_partkey, p_brand, p_name, p_size FROM part QUALIFY row_number() OVER (
  PARTITION BY p_brand, regexp_replace(lower(p_name), '[\\s_\\-]', '', 'g')
  ORDER BY CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END, p_partkey) = 1""")
def title_dedupe(spark, sf):
    part = S.table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    live = F.when(F.col("p_size") % 2 == 0, 0).otherwise(1)
    return dims.dedupe_by_title(part, "p_brand", "p_name", [live, F.col("p_partkey")], "p_partkey")


@query(with_(S.sql_items(), body="""SELECT id, shop, status FROM items QUALIFY row_number() OVER (
  PARTITION BY shop, status = 'now' ORDER BY seq, id) <= CASE WHEN status = 'now' THEN 60 ELSE 12 END"""))
def group_cap(spark, sf):
    items = S.items(spark, sf).select("id", "shop", "status", "seq")
    return dims.cap_per_group(items, "shop", F.col("status") == "now", 60, 12, [F.col("seq"), F.col("id")]).drop("seq")


@query(with_(S.sql_items(), SQL_NAMED, SQL_GOODS, """uniq AS (SELECT * FROM goods WHERE good QUALIFY row_number() OVER (
    PARTITION BY shop, regexp_replace(lower(name), '[\\s　_\\-\\[\\]（）()／/|、。,.:：!！’''"]', '', 'g') ORDER BY status <> 'now', id) = 1)""",
  body="SELECT id AS key, shop, name AS title, status FROM uniq"))
def curated_catalogue(spark, sf):
    products = _named(spark, sf).select(
        F.col("id").alias("key"), "shop", F.col("name").alias("title"), "grams", "status",
        (F.col("status") == "now").alias("available"))
    return publish.curate(products).select("key", "shop", "title", "status")


@query(with_(S.sql_items(), body="""SELECT id AS key, name, CASE WHEN origin = '' THEN 'ブレンド' ELSE origin END AS origin,
  CASE WHEN process = '' THEN 'Washed' ELSE process END AS process, process = '' AS process_default,
  printf('%.0f', amount)::DOUBLE AS amount, grams || 'g' AS per, CAST(coalesce(updated_at, DATE '2024-01-01') AS VARCHAR) AS updated_at,
  year(coalesce(updated_at, DATE '2024-01-01')) AS year,
  CASE WHEN regexp_matches(notes, '[A-Za-z]') THEN notes END AS notes, variety, award, estate, link FROM items"""))
def published_items(spark, sf):
    products = S.items(spark, sf).select(
        F.col("id").alias("key"), "shop", F.col("name").alias("title"), "origin", "process", F.col("amount").alias("price"),
        F.col("cur").alias("currency"), "grams", "status", F.col("updated_at").alias("first_seen"), "notes", "tags",
        F.lit("").alias("image"), F.col("link").alias("url"))
    return publish.publish_items(products, F.lit("2024-01-01").cast("date")).select(
        "key", "name", "origin", "process", "process_default", "amount", "per", F.col("updated_at").cast("string"), "year", "notes", "variety",
        "award", "estate", "link")


@query("""SELECT c_custkey AS key, c_name AS name, 'seed' AS source FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT o_custkey, o_orderpriority, 'live' FROM orders WHERE o_orderstatus = 'P'""")
def overlay_rows(spark, sf):
    seed = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("seed").alias("source"))
    live = S.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name"), F.lit("live").alias("source"))
    return dims.overlay_rows(seed, live, "key")


@query("""SELECT key, arg_max(name, pri) AS name FROM (SELECT c_custkey AS key, c_name AS name, 0 AS pri FROM customer
    UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT n_nationkey, n_name, 2 FROM nation) GROUP BY key""")
def overlay_dim(spark, sf):
    tables = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name")]
    parts = [S.table(spark, sf, t).select(F.col(k).cast("bigint").alias("key"), F.col(n).alias("name")) for t, k, n in tables]
    return dims.overlay_dim(parts, "key")


@query("""SELECT c_custkey AS key, c_mktsegment AS note FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1""")
def archive_append(spark, sf):
    stored = S.table(spark, sf, "customer").filter(F.col("c_custkey") % 3 == 0).select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("note"))
    current = S.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("note"), "o_orderkey")
    return dims.append_new(stored, current, "key", [F.col("o_orderkey")]).drop("o_orderkey")


@query("""SELECT c_custkey AS key, c_name AS name FROM customer
  UNION ALL SELECT o_custkey * 2, min(o_orderpriority) FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""")
def archive_view(spark, sf):
    current = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    stored = S.table(spark, sf, "orders").groupBy((2 * F.col("o_custkey")).alias("key")).agg(F.min("o_orderpriority").alias("name"))
    return dims.merged_view(current, stored, "key")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey // 4 IN (SELECT s_suppkey FROM supplier)
    THEN 'seed' || c_custkey // 4 ELSE lower(left('the' || 'shop' || c_custkey || 'coffeeroasters', 24)) END AS key,
  c_custkey % 4 = 0 AND c_custkey // 4 IN (SELECT s_suppkey FROM supplier) AS matched
  FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey // 4 IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT c_custkey, 'supplier' || c_custkey // 4, false FROM customer
  WHERE c_custkey % 4 = 0 AND c_custkey // 4 NOT IN (SELECT s_suppkey FROM supplier)""")
def seed_match(spark, sf):
    seed = S.table(spark, sf, "supplier").select(
        F.concat(F.lit("Supplier "), "s_suppkey", F.lit(" Roastery")).alias("name"),
        F.concat(F.lit("seed"), "s_suppkey").alias("key"))
    quarter = (F.col("c_custkey") / 4).cast("bigint")
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("SUPPLIER-"), quarter)).otherwise(
        F.concat(F.lit("The Shop "), "c_custkey", F.lit(" Coffee Roasters")))
    shops = S.table(spark, sf, "customer").select("c_custkey", name.alias("name"))
    return dims.match_seed_shops(shops, seed).select("c_custkey", "key", "matched")


def _cities(spark, sf):
    """Points of the cities, unknown for every fifth."""
    key = F.col("n_nationkey")
    return S.table(spark, sf, "nation").select(
        geo.city_key(F.col("n_name"), S.choose(S.COUNTRIES, key)).alias("city_key"),
        F.when(key % 5 != 0, key * 7.0 - 90).alias("lon"), F.when(key % 5 != 0, key * 2.5 - 30).alias("lat"),
        F.lit(True).alias("known"))


def _sql_point(i: int) -> str:
    whens = " ".join(f"WHEN '{c}' THEN {float(rules.COUNTRY_POINTS[c][i])!r}" for c in S.COUNTRIES)
    return f"CASE country {whens} END::DOUBLE"


@query(with_(S.sql_shops(), body=f"""SELECT shop, region, coalesce(CASE WHEN k % 5 <> 0 THEN k * 7.0 - 90 END, {_sql_point(0)})::DOUBLE AS lon,
  coalesce(CASE WHEN k % 5 <> 0 THEN k * 2.5 - 30 END, {_sql_point(1)})::DOUBLE AS lat
  FROM (SELECT *, CAST(substr(city, 8) AS INTEGER) AS k FROM shops)"""))
def shop_places(spark, sf):
    shops = S.shops(spark, sf).drop("region")
    return dims.place_shops(shops, _cities(spark, sf)).select("shop", "region", "lon", "lat")


@query("""SELECT DISTINCT lower(c_mktsegment) || '|' || CASE WHEN c_nationkey % 2 = 0 THEN 'JP' ELSE 'US' END AS city_key
  FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def unresolved_cities(spark, sf):
    places = S.table(spark, sf, "customer").select(
        F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("city"),
        F.when(F.col("c_nationkey") % 2 == 0, "jp").otherwise("us").alias("country"))
    known = S.table(spark, sf, "nation").select(
        F.concat(F.lit("building|"), F.when(F.col("n_nationkey") % 2 == 0, "JP").otherwise("US")).alias("city_key"))
    return dims.unresolved_cities(dims.distinct_places(places), known)


@query(with_(S.sql_shops(), body="""SELECT shop FROM shops WHERE CAST(substr(shop, 2) AS BIGINT) % 6 = 0 OR
  (CAST(substr(shop, 2) AS BIGINT) % 6 = 1)"""))
def countries_as_cities(spark, sf):
    shops = S.shops(spark, sf)
    number = F.substring("shop", 2, 20).cast("bigint")
    odd = shops.withColumn("city", F.when(number % 6 == 0, F.lower("country")).when(number % 6 == 1, "Hong Kong")
                           .otherwise(F.col("city")))
    return dims.countries_as_cities(odd).select("shop")


SQL_CHECK = """p AS (SELECT c_custkey, c_nationkey, CAST(c_custkey % 25 AS DOUBLE) * 7 - 90 + c_acctbal / 1000 AS lon,
    CAST(c_custkey % 25 AS DOUBLE) * 2.5 - 30 AS lat, c_custkey % 30 AS k FROM customer),
  d AS (SELECT p.*, 2 * 6371 * asin(sqrt(pow(sin((radians(n_nationkey * 2.5 - 30) - radians(lat)) / 2), 2)
      + cos(radians(lat)) * cos(radians(n_nationkey * 2.5 - 30)) * pow(sin((radians(n_nationkey * 7.0 - 90) - radians(lon)) / 2), 2))) AS km
    FROM p LEFT JOIN nation ON n_nationkey = k)"""


@query(with_(SQL_CHECK, body="""SELECT c_custkey, round(km, 6) AS km,
  CASE WHEN km IS NULL THEN 'missing' WHEN km > 60 THEN 'far' ELSE 'ok' END AS verdict FROM d"""))
def position_check(spark, sf):
    key = F.col("c_custkey")
    place = (key % 25).cast("double")
    points = S.table(spark, sf, "customer").select(
        "c_custkey", (key % 30).alias("k"), (place * 7 - 90 + F.col("c_acctbal") / 1000).alias("lon"), (place * 2.5 - 30).alias("lat"))
    n = F.col("n_nationkey")
    reference = S.table(spark, sf, "nation").select(
        n.cast("bigint").alias("k"), (n * 7.0 - 90).alias("ref_lon"), (n * 2.5 - 30).alias("ref_lat"))
    return dims.position_check(points, reference, "k").select("c_custkey", F.round("km", 6).alias("km"), "verdict")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 = 12 % 7""")
def shop_shard(spark, sf):
    return dims.shard(S.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "12/7")


@query("""SELECT p_partkey, lower(replace(p_name, ' ', '')) AS title, regexp_replace(replace(lower(p_name), 'small', ''), '[^a-z0-9]', '', 'g')
  || 'x' AS shop, left(regexp_replace(lower(p_type || p_name || p_brand), '[^a-z0-9]', '', 'g'), 24) AS slug FROM part""")
def normalised_names(spark, sf):
    part = S.table(spark, sf, "part")
    shop = F.concat(F.replace("p_name", F.lit("small"), F.lit("The Coffee")), F.lit(" Co. x"))
    return part.select("p_partkey", title_key(F.concat(F.upper("p_name"), F.lit(" - "))).alias("title"),
                       shop_key(shop).alias("shop"), slug(F.concat("p_type", "p_name", "p_brand")).alias("slug"))


@query(with_(S.sql_items(), body="""SELECT id, CASE WHEN name LIKE '%Colombia' THEN 'Colombia' ELSE '' END AS origin,
  CASE WHEN name LIKE '%Anaerobic%' THEN 'Anaerobic' WHEN name LIKE '%Honey%' THEN 'Honey' WHEN name LIKE '%Natural%' THEN 'Natural'
    WHEN name LIKE '%Washed%' THEN 'Washed' ELSE '' END AS process,
  CASE WHEN name LIKE '%250g' THEN 250 WHEN name LIKE '%1kg%' THEN 1000 ELSE 0 END AS grams FROM items"""))
def title_guesses(spark, sf):
    name = F.col("name")
    return S.items(spark, sf).select("id", guess_origin(name).alias("origin"), guess_process(name).alias("process"),
                                     grams_from_text(name).alias("grams"))


@query(with_(S.sql_items(), body="""SELECT id, origin_group, process_class, CASE WHEN p100 >= 5000 THEN 'premium'
  WHEN p100 >= 3000 THEN 'midhigh' ELSE process_class END AS display FROM items"""))
def item_classes(spark, sf):
    items = S.items(spark, sf)
    kind = classify.process_class(F.col("process"))
    p100 = price.per100_yen(F.col("amount"), price.yen_rate(F.col("cur")), F.col("grams"))
    return items.select("id", classify.origin_group(F.col("origin")).alias("origin_group"), kind.alias("process_class"),
                        price.display_class(p100, kind).alias("display"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2024-06-01' END AS seen,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN epoch(o_orderdate)
    END AS first_seen, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'old' END AS notes FROM orders""")
def state_repair(spark, sf):
    key = F.col("o_orderkey")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")
    stored = F.when(key % 3 == 0, F.col("o_orderpriority")).when(key % 3 == 1, seconds)
    first, notes = repair_first_seen(stored, key.cast("double"), F.lit("old"))
    return S.table(spark, sf, "orders").select(
        "o_orderkey", first_seen_date(stored, F.lit("2024-06-01").cast("date")).cast("string").alias("seen"), first.alias("first_seen"),
        notes.alias("notes"))


UTM = links.DEFAULT_TRACKING


@query(with_(S.sql_items(), S.sql_shops(), body=f"""SELECT id, kind, CASE kind WHEN 'direct' THEN link || '?{UTM}'
    WHEN 'search' THEN 'https://' || url || '/search?q=' || replace(replace(words, ' ', '%20'), '#', '%23') || '&type=product&{UTM}'
    WHEN 'shop' THEN 'https://' || url || '?{UTM}' END AS href
  FROM (SELECT i.id, i.link, s.url, i.name AS words, CASE WHEN s.url = '' THEN 'none' WHEN i.link IS NOT NULL THEN 'direct'
    WHEN s.platform = 'Shopify' THEN 'search' ELSE 'shop' END AS kind FROM items i JOIN shops s USING (shop))"""))
def item_links(spark, sf):
    rows = S.items(spark, sf).join(S.shops(spark, sf).select("shop", "url", "platform", "country"), "shop")
    words = links.search_words(F.col("name"), F.col("country"))
    args = (F.col("url"), F.col("platform"), F.col("link"), words)
    return rows.select("id", links.link_kind(*args).alias("kind"), links.item_link(*args).alias("href"))


@query("""SELECT page_id, replace(regexp_extract(url, '^https?://([^/]+)', 1), 'www.', '') AS host,
  lower(replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^/+|/+$', '', 'g'), 'www.', '')) AS bare,
  CASE WHEN regexp_matches(url, '^https?://www\\.') THEN regexp_replace(url, '://www\\.', '://')
    ELSE regexp_replace(url, '://', '://www.') END AS other FROM pages""")
def page_hosts(spark, sf):
    url = F.col("url")
    return S.table(spark, sf, "pages").select(
        "page_id", links.host(url).alias("host"), links.bare_host(url).alias("bare"), links.toggle_www(url).alias("other"))
