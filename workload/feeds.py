"""Queries on landed payloads and texts: feeds built from the tables, pages, documents, streams."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from tallyshelf import session
from tallyshelf.functions import classify
from tallyshelf.functions import text as X
from tallyshelf.operators import dims
from tallyshelf.operators.pick import latest_per_key
from tallyshelf.session import settle
from tallyshelf.sinks.buckets import BucketLog, BucketTable
from tallyshelf.sinks.tables import read_events
from tallyshelf.sources import articles, feeds, sitemaps
from tallyshelf.sources import dims as dim_sources
from tallyshelf.streaming import billing_stream, diff_stream
from workload import standins as S
from workload.people import SQL_BILLING
from workload.registry import query, with_
from workload.tracking import SQL_EVENTS

# --- shop feeds: the part table as the goods of its brands, landed as payloads ----------------------


def _goods(spark, sf):
    """Parts with the texts a shop would write about them, forty to a document however many there are."""
    p, key = S.dealt(S.table(spark, sf, "part")), F.col("p_partkey")
    return p.select(
        key.alias("k"), F.col("p_brand").alias("shop"), F.floor(key / 40).alias("page"),
        F.concat_ws(" ", "p_name", S.choose(["Kenya", "", "Peru"], key), S.choose(["Washed", "", "Honey 250g", "1kg"], key)).alias("title"),
        F.format_string("%.2f", "p_retailprice").alias("price"), F.col("p_size").alias("size"),
        S.choose(["<p>Region: Huila</p><p>Tasting Notes</p><p>peach, lime &amp; cocoa</p>",
                  "<div>Flavour notes: jasmine tea.</div><script>var x='<p>Rose</p>'</script>",
                  "<p>Natural lot from Rwanda<br>plum and fig jam</p>", "<p>Nothing to say</p>", ""], key).alias("body"),
    )


SQL_GOODS = f"""goods AS (SELECT p_partkey AS k, p_brand AS shop, p_size AS size, p_retailprice AS price,
    concat_ws(' ', p_name, {S._pick(["Kenya", "", "Peru"], 'p_partkey')}, {S._pick(["Washed", "", "Honey 250g", "1kg"], 'p_partkey')}) AS title, p_partkey % 5 AS b,
    {S._pick(["peach, lime & cocoa", "jasmine tea", "plum and fig jam", "", ""], 'p_partkey')} AS notes,
    {S._pick([0, 0, 250, 1000], 'p_partkey')} AS text_grams, {S._pick(["Kenya", "", "Peru"], 'p_partkey')} AS o,
    {S._pick(["Washed", "", "Honey", ""], 'p_partkey')} AS pr FROM part),
  known AS (SELECT *, CASE WHEN o <> '' THEN o WHEN b = 2 THEN 'Rwanda' ELSE '' END AS origin,
    CASE WHEN pr <> '' THEN pr WHEN b = 2 THEN 'Natural' ELSE '' END AS process FROM goods)"""

COLUMNS = ["key", "title", "price", "grams", "per100", "available", "origin", "process", "notes"]


def _shown(products, *more):
    return products.select(*COLUMNS, *more).withColumn("per100", F.coalesce("per100", F.lit(-1.0)))


def _packed(rows, entry):
    """One landed body per (shop, page), a page holding the shop's goods of that page."""
    return rows.groupBy("shop", "page").agg(F.collect_list(entry).alias("products"))


@query(with_(SQL_GOODS, """v AS (SELECT *, CASE WHEN size % 3 = 0 THEN 0 ELSE size * 10 END AS vg FROM known WHERE size % 7 <> 0),
    g AS (SELECT *, CASE WHEN vg > 0 THEN vg ELSE text_grams END AS grams FROM v)""", body="""
  SELECT shop || '::p' || k AS key, trim(title) AS title, price, grams, CASE WHEN grams > 0 THEN printf('%.2f', price / grams * 100)::DOUBLE ELSE -1 END AS per100,
    size % 2 = 0 AS available, origin, process, notes, 'https://x.example/products/p' || k AS url FROM g"""))
def shop_feed(spark, sf):
    none_first = F.struct(F.lit("x").alias("title"), F.lit("1").alias("price"), F.lit(5).alias("grams"), F.lit(False).alias("available"))
    variant = F.struct(F.lit("bag").alias("title"), F.col("price"), F.when(F.col("size") % 3 == 0, 0).otherwise(F.col("size") * 10).alias("grams"),
                       (F.col("size") % 2 == 0).alias("available"))
    variants = F.when(F.col("size") % 2 == 0, F.array(none_first, variant)).otherwise(F.array(variant))
    entry = F.struct(
        F.concat(F.lit("p"), "k").alias("handle"), "title", F.when(F.col("size") % 7 == 0, "Brewing Gear").otherwise("Coffee").alias("product_type"),
        F.array(F.lit("single"), F.lit("filter")).alias("tags"), F.col("body").alias("body_html"), variants.alias("variants"))
    landed = _packed(_goods(spark, sf), entry).select(
        "shop", F.lit("JP").alias("country"), F.lit("https://x.example/").alias("url"), F.lit("JPY").alias("currency"),
        F.to_json(F.struct("products")).alias("body"))
    return _shown(feeds.normalise_shop_json(landed), "url")


@query(with_(SQL_GOODS, body="""SELECT shop || '::' || k AS key, trim(title) AS title, price, text_grams AS grams,
    CASE WHEN text_grams > 0 THEN printf('%.2f', price / text_grams * 100)::DOUBLE ELSE -1 END AS per100, coalesce(size % 3 <> 0, true) AS available,
    origin, process, notes, CASE WHEN size % 2 = 0 THEN 'EUR' ELSE 'JPY' END AS currency FROM known"""))
def store_feed(spark, sf):
    cents = F.replace("price", F.lit("."), F.lit(""))
    entry = F.struct(
        F.col("k").alias("id"), F.concat(F.lit("<b>"), "title", F.lit("</b> ")).alias("name"), F.lit("").alias("short_description"),
        F.col("body").alias("description"), F.when(F.col("size") % 3 == 0, False).when(F.col("size") % 3 == 1, True).alias("is_in_stock"),
        F.struct(cents.alias("price"), F.when(F.col("size") % 2 == 0, "EUR").alias("currency_code")).alias("prices"))
    landed = _packed(_goods(spark, sf), entry).select(
        "shop", F.lit("JP").alias("country"), F.lit("https://x.example/").alias("url"), F.lit("JPY").alias("currency"),
        F.to_json("products").alias("body"))
    return _shown(feeds.normalise_store_json(landed), "currency")


@query(with_(SQL_GOODS, body="""SELECT shop || '::p' || k AS key, trim(title || ' & Co') AS title, CASE WHEN size % 4 = 0 THEN 0 ELSE price END AS price, text_grams AS grams,
    CASE WHEN text_grams > 0 AND size % 4 <> 0 THEN printf('%.2f', price / text_grams * 100)::DOUBLE ELSE -1 END AS per100, true AS available,
    origin, CASE WHEN b = 2 AND pr <> 'Honey' THEN 'Natural' ELSE pr END AS process, notes FROM known WHERE size % 5 <> 0"""))
def atom_feed(spark, sf):
    escaped = F.replace(F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    price = F.when(F.col("size") % 4 == 0, "").otherwise(F.concat(F.lit('<s:price currency="EUR">'), "price", F.lit("</s:price>")))
    title = F.when(F.col("size") % 5 == 0, "").otherwise(F.concat(F.lit("<title>"), "title", F.lit(" &amp; Co</title>")))
    entry = F.concat(F.lit("<entry>"), title, F.lit('<link rel="alternate" href="https://x.example/products/p'), "k", F.lit('"/>'), price,
                     F.lit('<summary type="html">'), escaped, F.lit("</summary></entry>"))
    landed = _packed(_goods(spark, sf), entry).select(
        "shop", F.lit("JP").alias("country"), F.lit("https://x.example/").alias("url"), F.lit("JPY").alias("currency"),
        F.concat(F.lit("<feed>\n"), F.array_join("products", "\n"), F.lit("</feed>")).alias("body"))
    return _shown(feeds.normalise_atom(landed))


def _atom_files(spark, sf):
    """A folder of Atom files by shop. Of the entries some have a bare ampersand, some are never closed; the title names HTML's references."""
    escaped = F.replace(F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    price = F.when(F.col("size") % 4 == 0, "").otherwise(F.concat(F.lit('<s:price currency="EUR">'), "price", F.lit("</s:price>")))
    title = F.concat(F.lit("<title>"), "title", F.when(F.col("k") % 10 == 3, " & Co</title>").when(F.col("k") % 10 == 7, " &amp; Co")
                     .otherwise(" &amp; Co &eacute;&amp;lt;</title>"))
    entry = F.concat(F.lit("<entry>"), title, F.lit('\n<link rel="alternate" href="https://x.example/products/p'), "k", F.lit('"/>'), price,
                     F.lit('<summary type="html">'), escaped, F.lit("</summary></entry>"))
    landed = _packed(_goods(spark, sf), entry).select("shop", F.concat(F.lit('<feed xmlns:s="urn:x">\n'), F.array_join("products", "\n"), F.lit("</feed>")).alias("value"))
    folder = f"{_run_folder(spark)}/atom"
    landed.repartition("shop").write.partitionBy("shop").text(folder)
    shops = _goods(spark, sf).select("shop").distinct().select(
        "shop", F.lit("JP").alias("country"), F.lit("https://x.example/").alias("url"), F.lit("JPY").alias("currency"))
    return feeds.read_atom(spark, folder, shops)


@query(with_(SQL_GOODS, body="""SELECT shop || '::p' || k AS key, trim(title || ' & Co é&lt;') AS title, CASE WHEN size % 4 = 0 THEN 0 ELSE price END AS price, text_grams AS grams,
    CASE WHEN text_grams > 0 AND size % 4 <> 0 THEN printf('%.2f', price / text_grams * 100)::DOUBLE ELSE -1 END AS per100, true AS available,
    origin, CASE WHEN b = 2 AND pr <> 'Honey' THEN 'Natural' ELSE pr END AS process, notes, CASE WHEN size % 4 = 0 THEN 'JPY' ELSE 'EUR' END AS currency
    FROM known WHERE k % 10 NOT IN (3, 7)"""))
def atom_files(spark, sf):
    return _shown(_atom_files(spark, sf)[0], "currency")


@query("""SELECT p_brand AS shop, p_partkey AS k, p_partkey % 10 = 3 AS closed FROM part WHERE p_partkey % 10 IN (3, 7)""")
def atom_broken(spark, sf):
    """Entries that are no XML, whole, each apart from its neighbours."""
    return _atom_files(spark, sf)[1].select("shop", F.regexp_extract("element", r'products/p(\d+)"', 1).cast("bigint").alias("k"),
                                            F.col("element").contains("</title>").alias("closed"))


@query(with_(SQL_GOODS, body="""SELECT shop || '::p' || k AS key, trim(title) AS title, CASE WHEN k % 6 = 5 THEN 0 ELSE price END AS price, text_grams AS grams,
    CASE WHEN text_grams > 0 AND k % 6 <> 5 THEN printf('%.2f', price / text_grams * 100)::DOUBLE ELSE -1 END AS per100,
    size % 3 <> 0 AS available, origin, process, notes, CASE WHEN k % 6 = 4 THEN 'https://img.example/a.jpg' ELSE '' END AS image FROM known WHERE k % 6 <> 0"""))
def page_feed(spark, sf):
    stock = F.when(F.col("size") % 3 == 0, "https://schema.org/OutOfStock").when(F.col("size") % 3 == 1, "https://schema.org/InStock")
    thousands = F.concat(F.substring("price", 1, 1), F.lit(","), F.substring("price", 2, 20))
    offer = F.struct(thousands.alias("price"), F.lit("jpy").alias("priceCurrency"), stock.alias("availability"))
    aggregate = F.struct(F.lit("AggregateOffer").alias("@type"), F.col("price").alias("lowPrice"), stock.alias("availability"))
    no_offer = F.struct(stock.alias("availability"))
    base = [F.lit("Product").alias("@type"), F.col("title").alias("name"), F.col("body").alias("description")]
    plain = F.to_json(F.struct(*base, offer.alias("offers")))
    graph = F.to_json(F.struct(F.array(F.struct(*base, F.array(aggregate).alias("offers"))).alias("@graph")))
    graph = F.replace(graph, F.lit('"@graph":['), F.lit('"@graph":[{"@type":"WebPage","name":"x"},'))
    listed = F.concat(F.lit("["), plain, F.lit("]"))
    with_image = F.to_json(F.struct(*base, offer.alias("offers"), F.array(F.lit("https://img.example/a.jpg")).alias("image")))
    unpriced = F.to_json(F.struct(*base, no_offer.alias("offers")))
    kind = F.col("k") % 6
    data = (F.when(kind == 1, plain).when(kind == 2, graph).when(kind == 3, listed).when(kind == 4, with_image).otherwise(unpriced))
    # The closing tag inside a script string is escaped, as shops do.
    script = F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'),
                      F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    pages = _goods(spark, sf).select(
        "shop", F.lit("JP").alias("country"), F.lit("JPY").alias("currency"),
        F.concat(F.lit("https://x.example/items/p"), "k", F.lit("/")).alias("url"),
        F.when(kind == 0, "<html>no data</html>").otherwise(F.concat(F.lit("<html>"), script, F.lit("</html>"))).alias("body"))
    return _shown(feeds.normalise_product_pages(pages), "image")


@query("""WITH d AS (SELECT p_brand AS shop, p_partkey AS k, p_partkey % 8 AS m, row_number() OVER (PARTITION BY p_brand, p_partkey // 200 ORDER BY p_partkey) - 1 AS pos FROM part),
  u AS (SELECT shop, CASE WHEN m = 1 THEN 'https://x.example/items/i' ELSE 'https://x.example/products/i' END || k AS url, pos FROM d WHERE m NOT IN (2, 3, 4))
  SELECT shop, url, pos AS place FROM u""")
def sitemap_urls(spark, sf):
    key = F.col("p_partkey")
    loc = (F.when(key % 8 == 1, F.concat(F.lit("https://x.example/items/i"), key)).when(key % 8 == 2, F.concat(F.lit("https://x.example/pages/i"), key))
           .when(key % 8 == 3, F.concat(F.lit("mailto:a@x.example/products/i"), key)).when(key % 8 == 4, F.concat(F.lit("https://x.example/blogs/shop/i"), key))
           .otherwise(F.concat(F.lit("/products/i"), key)))
    parts = S.table(spark, sf, "part").select(F.col("p_brand").alias("shop"), F.floor(key / 200).alias("map"), F.struct(key, F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>"))).alias("e"))
    product_map = parts.groupBy("shop", "map").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["col2"]), "\n").alias("body"))
    product_map = product_map.withColumn("url", F.concat(F.lit("https://x.example/sm/products_"), "map", F.lit(".xml")))
    # The index of a shop names a map for every two hundred parts.
    index = product_map.groupBy("shop").agg(F.concat(F.lit("<loc>https://x.example/sm/pages_1.xml</loc>"), F.array_join(F.collect_list(
        F.concat(F.lit("<loc> /sm/products_"), "map", F.lit(".xml </loc>"))), "")).alias("body")).select(
        "shop", F.lit("https://x.example/sitemap.xml").alias("url"), "body")
    landed = index.unionByName(product_map.select("shop", "url", "body"))
    shops = index.select("shop", F.lit("https://x.example/").alias("base"))
    return sitemaps.product_urls(landed, shops).select("shop", "url", F.element_at("place", -1).cast("bigint").alias("place"))


@query("""SELECT lang || doc_id // 20 AS feed, row_number() OVER (PARTITION BY lang, doc_id // 20 ORDER BY doc_id) AS place, 'Doc ' || doc_id || ' <1>' AS title, 'https://x.example/' || doc_id AS url,
  '2026-' || CASE WHEN doc_id % 2 = 0 THEN '08' ELSE '01' END || '-0' || (1 + doc_id % 9) AS date,
  left(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(text, ']]>', ']] >'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\\s+', ' ', 'g')), 90) AS excerpt
  FROM documents WHERE doc_id % 3 <> 0 QUALIFY place <= 5""")
def rss_articles(spark, sf):
    """Feeds of twenty documents at most: their number grows with the table, their size does not."""
    d, key = S.table(spark, sf, "documents"), F.col("doc_id")
    month = F.when(key % 2 == 0, "Aug").otherwise("Xxx")
    link = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("<link>https://x.example/"), key, F.lit("</link>")))
    item = F.concat(F.lit("<item><title>Doc "), key, F.lit(" &lt;1&gt;</title>"), link, F.lit("<pubDate>Sat, 0"), 1 + key % 9, F.lit(" "), month,
                    F.lit(" 2026 09:00:00 +0900</pubDate><description><![CDATA[<p>"), F.replace("text", F.lit("]]>"), F.lit("]] >")),
                    F.lit("</p>]]></description></item>"))
    feed = F.concat("lang", F.floor(key / 20).cast("string"))
    packed = d.groupBy(feed.alias("feed")).agg(F.array_sort(F.collect_list(F.struct(key, item.alias("item")))).alias("e"))
    landed = packed.select("feed", F.concat(F.lit("<rss>"), F.array_join(F.transform("e", lambda e: e["item"]), ""), F.lit("</rss>")).alias("body"))
    rows = articles.parse_rss(landed, 5, 90)
    return rows.select("feed", F.col("place").cast("bigint").alias("place"), "title", "url", "date", "excerpt")


# --- dimension files ---------------------------------------------------------------------------------

@query("""SELECT 'k' || c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Oslo' ELSE '' END AS city, 'NO' AS country,
  c_custkey / 8.0::DOUBLE AS lon, -c_acctbal AS lat FROM customer WHERE c_custkey % 5 <> 0""")
def seed_scan(spark, sf):
    key = F.col("c_custkey")
    line = F.concat(F.lit("  k"), key, F.lit(': { name: "'), "c_name", F.lit('", city: "'), F.when(key % 2 == 0, "Oslo").otherwise(""),
                    F.lit('", country: "NO", region: "x", coord: [ '), (key / 8.0).cast("decimal(20,3)").cast("string"), F.lit(", "),
                    (-F.col("c_acctbal")).cast("decimal(20,2)").cast("string"), F.lit("], url: 'x' },"))
    lines = S.table(spark, sf, "customer").select(F.when(key % 5 == 0, F.lit("// note")).otherwise(line).alias("value"))
    return dim_sources.seed_shops(lines)


@query("""SELECT lower(c_name) || '|NO' AS city_key, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey / 8.0::DOUBLE ELSE -1 END AS lon,
  CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal ELSE -1 END AS lat, true AS known FROM customer WHERE c_custkey % 50 <> 7""")
def city_cache(spark, sf):
    key = F.col("c_custkey")
    point = F.when(key % 3 != 0, F.array(key / 8.0, F.col("c_acctbal")))
    entry = F.map_from_arrays(F.array(F.concat(F.lower("c_name"), F.lit("|NO"))), F.array(point))
    text = F.when(key % 50 == 7, "{broken").otherwise(F.to_json(entry, {"ignoreNullFields": "false"}))
    cache = dim_sources.city_cache(S.table(spark, sf, "customer").select(text.alias("value")))
    return cache.na.fill(-1.0, ["lon", "lat"])


# --- texts -------------------------------------------------------------------------------------------

SQL_PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
    '(?i)<\s*(br|/p|/div|/li|/tr|/h[1-6])\s*/?>', chr(10), 'g'), '(?is)<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
  '[ \t　]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g'))"""


@query(f"SELECT page_id, {SQL_PLAIN} AS text FROM pages")
def page_text(spark, sf):
    return S.dealt(S.table(spark, sf, "pages")).select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(f"""WITH l AS (SELECT page_id, unnest(string_split({SQL_PLAIN}, chr(10))) AS line, generate_subscripts(string_split({SQL_PLAIN}, chr(10)), 1) AS i FROM pages),
  s AS (SELECT *, len(list_distinct(regexp_extract_all(lower(line), 'berr|cassis|cherry|plum|straw|blueberr|raspberr|currant|acerola|hibiscus|citrus|lemon|lime|orange|grapefruit|mandarin|bergamot|yuzu|floral|jasmine|rose|tea\\b|lavender|chamomile|blossom|tropical|pineapple|mango|lychee|passion|guava|melon|peach|apricot|papaya|chocolate|cocoa|cacao|nut|almond|hazelnut|caramel|toffee|brown\\s*sugar|honey|vanilla|malt|molasses|syrup|apple|pear|grape|fig|date|raisin|tamarind|rhubarb|lemongrass|nougat|cane|spice|cinnamon'))) AS words FROM l)
  SELECT p.page_id, coalesce((SELECT arg_min(trim(line, ' .．、,:：-–—/|'), i) FROM s WHERE s.page_id = p.page_id AND words >= 2 AND length(line) BETWEEN 5 AND 90), '') AS notes FROM pages p""")
def page_notes(spark, sf):
    return S.dealt(S.table(spark, sf, "pages")).select("page_id", X.extract_notes(F.col("html"), 160).alias("notes"))


@query("""SELECT page_id, CASE WHEN regexp_matches(html || url, '(?i)cdn\\.shopify\\.com') THEN 'Shopify' WHEN regexp_matches(html || url, '(?i)wix\\.com') THEN 'Wix'
  WHEN regexp_matches(html || url, '(?i)wp-content|wp-json') THEN 'WordPress' WHEN page_id % 4 = 0 THEN 'WooCommerce' ELSE 'unknown' END AS platform,
  len(regexp_extract_all(html, '(?i)href="/[^"/]+"')) AS links FROM pages""")
def page_platforms(spark, sf):
    pages = S.dealt(S.table(spark, sf, "pages"))
    marked = F.concat("html", "url", F.when(F.col("page_id") % 4 == 0, " <link href='/WooCommerce.css'>").otherwise(""))
    links = F.size(F.regexp_extract_all("html", F.lit('(?i)href="/[^"/]+"'), 0)).cast("bigint")
    return pages.select("page_id", classify.platform(marked, limit=None).alias("platform"), links.alias("links"))


@query("""WITH f AS (SELECT page_id, page_id % 3 = 0 AS fetched, page_id % 4 = 0 AS woo, page_id % 5 < 2 AS linked, page_id % 7 < 3 AS ld FROM pages)
  SELECT CASE WHEN fetched THEN 'fetched' WHEN woo THEN 'WooCommerce' ELSE 'unknown' END AS label, count(*) AS n FROM f GROUP BY 1
  UNION ALL SELECT '*sitemap', count(*) FILTER (NOT fetched AND linked) FROM f UNION ALL SELECT '*structured', count(*) FILTER (NOT fetched AND ld) FROM f""")
def platform_tally(spark, sf):
    key = F.col("page_id")
    ld = F.when(key % 7 < 3, '<script type="application/ld+json">{"@type": "Product"}</script>').otherwise("")
    site = F.when(key % 5 < 2, F.concat(F.lit("<loc>https://x.example/products/"), key, F.lit("</loc>"))).otherwise("<loc>https://x.example/about</loc>")
    home = F.concat("html", ld, F.when(key % 4 == 0, "woocommerce").otherwise(""))
    shops = S.table(spark, sf, "pages").select(
        (key % 3 == 0).alias("fetched"), classify.platform(home, limit=None).alias("platform"),
        classify.product_like_links(site).alias("sitemap_links"), classify.structured_kinds(home).alias("structured"))
    return dims.platform_tally(shops)


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), 'ベリー|苺|いちご|ストロベリー|ラズベリー|ブルーベリー|カシス|クランベリー|赤い果実|レッドフルーツ|プラム|チェリー|さくらんぼ|アセロラ|ハイビスカス|レーズン|干しぶどう|イチジク|red\s*fruit|berr|cassis|currant|cherry|plum|acerola|hibiscus|rhubarb|raisin|fig\b|date\b|pomegranate'))) AS berry,
  len(list_distinct(regexp_extract_all(lower(text), 'トロピカル|パイナップル|マンゴー|ライチ|パッション|パパイヤ|グァバ|グアバ|メロン|マスカット|白ぶどう|ピーチ|白桃|杏|アプリコット|スターフルーツ|バナナ|tropical|pineapple|mango|lychee|passion|guava|papaya|melon|muscat|peach|apricot|starfruit|banana|nectarine'))) AS tropical,
  len(list_distinct(regexp_extract_all(lower(text), 'フローラル|花|ジャスミン|ローズ|薔薇|バラ|紅茶|ティー|ベルガモット|アールグレイ|オレンジフラワー|カモミール|ラベンダー|すみれ|バイオレット|レモングラス|ハーブ|floral|jasmine|rose\b|blossom|tea\b|bergamot|earl\s*grey|lavender|chamomile|violet|lemongrass|herbal|citronella'))) AS floral,
  len(list_distinct(regexp_extract_all(lower(text), '柑橘|シトラス|レモン|ライム|オレンジ|グレープフルーツ|マンダリン|みかん|ゆず|すだち|グレフル|青りんご|青リンゴ|リンゴ酸|citrus|lemon|lime|orange|grapefruit|mandarin|yuzu|clementine|tangerine|green\s*apple|crisp'))) AS citrus,
  len(list_distinct(regexp_extract_all(lower(text), 'チョコ|カカオ|ココア|ナッツ|アーモンド|ヘーゼル|クルミ|キャラメル|ブラウンシュガー|黒糖|きび砂糖|蜂蜜|はちみつ|バニラ|モルト|麦芽|スパイス|シナモン|クローブ|香ばし|ロースト|トフィー|糖蜜|ヌガー|chocolate|cocoa|cacao|nut|almond|hazelnut|walnut|caramel|toffee|brown\s*sugar|molasses|honey|vanilla|malt|spice|cinnamon|nougat|cane\s*sugar|praline|fudge'))) AS choco
  FROM documents""")
def word_families(spark, sf):
    from tallyshelf.functions import flavour

    scores = S.dealt(S.table(spark, sf, "documents")).select("doc_id", flavour.score_struct(F.lower("text")).alias("s"))
    return scores.select("doc_id", *[F.col(f"s.{f}").cast("bigint").alias(f) for f in ("berry", "tropical", "floral", "citrus", "choco")])


@query("""SELECT turn_key, c AS excerpt FROM (SELECT conv_id * 1000 + turn AS turn_key, left(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '\\s+', ' ', 'g')), 90) AS c FROM conversations)""")
def excerpts(spark, sf):
    rows = S.table(spark, sf, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_key"), X.plain_excerpt(F.col("text"), 90).alias("excerpt"))


# --- streams -----------------------------------------------------------------------------------------

def _run_folder(spark) -> str:
    """A new folder for one run beside the session's checkpoints, deleted with what was settled."""
    return session.delete_later(posixpath.join(session.ensure_checkpoint_dir(spark), f"run-{uuid.uuid4().hex}"))


def _as_stream(spark, table, folder):
    """The table as a file stream."""
    table.write.parquet(f"{folder}/in")
    return spark.readStream.schema(table.schema).parquet(f"{folder}/in")


@query(with_(SQL_EVENTS, body="SELECT CAST(key AS VARCHAR) AS key, type, ts, oos_hours FROM diff"))
def snapshot_stream(spark, sf):
    """Batches go into the state table by time slices, so a key that fills a batch is no single task."""
    folder = _run_folder(spark)
    rows = S.snapshots(spark, sf).select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "available")
    state = BucketTable(spark, f"{folder}/state", "key STRING, available BOOLEAN, first_seen TIMESTAMP, last_seen TIMESTAMP, last_status_change TIMESTAMP")
    diff_stream.track(_as_stream(spark, rows, folder), state, f"{folder}/events", f"{folder}/cp").awaitTermination()
    return read_events(spark, f"{folder}/events").drop("event_date").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(with_(SQL_BILLING, body="SELECT event_id, type FROM ev"))
def events_once(spark, sf):
    """Three batches by the hash of the event; every third event comes again in a batch of another."""
    from workload.people import billing_events

    folder = _run_folder(spark)
    rows = settle(billing_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "type", "ts"))
    ids = BucketLog(spark, f"{folder}/ids", "event_id STRING")
    at = F.pmod(F.xxhash64("event_id"), F.lit(3))
    again = F.substring("event_id", 2, 20).cast("bigint") % 3 == 0
    for number in range(3):
        fresh = billing_stream.first_deliveries(rows.filter((at == number) | (again & (at == number - 1))), ids, number)
        fresh.write.parquet(f"{folder}/out/batch={number}")
    return spark.read.schema("event_id STRING, type STRING, ts TIMESTAMP").parquet(f"{folder}/out").select("event_id", "type")


@query("""SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def latest_per_key_rows(spark, sf):
    orders = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return latest_per_key(orders, ["key"], [F.col("o_orderkey")])
