import json

from pyspark.sql import functions as F

from tallyshelf.plans import publish, track
from tallyshelf.sources import articles, dims, feeds, sitemaps

LONG = "<p>" + "Grown on terraces above the river by forty families. " * 40 + "</p><p>Dried on beds, natural, lots from Rwanda.</p>"
SHOP = {
    "_roaster": {"name": "Harbour Beans", "country": "NO", "url": "https://harbour.test", "currency": "NOK"},
    "products": [
        {"handle": "kiambu", "title": "Kiambu AA Kenya", "tags": "washed, light", "variants": [
            {"price": "99", "grams": 125, "available": False}, {"price": "189.5", "grams": 250, "available": True}]},
        {"handle": "river", "title": "River lot", "tags": [], "body_html": LONG, "variants": [{"price": "n/a", "grams": 300, "available": True}]},
        {"handle": "gone", "title": "Brazil pulped natural", "tags": ["x"] * 200, "variants": [{"price": "120", "grams": 0, "available": False}]},
        {"handle": "noted", "title": "Honey micro lot Panama", "tags": [], "body_html": "<ul><li>Altitude 1800</li><li>Flavor notes: plum, cocoa nib</li></ul>",
         "variants": [{"price": "240", "grams": 200, "available": True}]},
    ],
}


def by_key(df):
    return {r.key.split("::")[1]: r for r in df.collect()}


def landed_snapshot(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "harbour.json").write_text(json.dumps(SHOP))
    return feeds.read_snapshot(spark, str(tmp_path / "in"))


def test_snapshot_files(spark, tmp_path):
    rows = by_key(landed_snapshot(spark, tmp_path))
    k, r, g, n = (rows[x] for x in ("kiambu", "river", "gone", "noted"))
    assert (k.price, k.grams, k.per100, k.available, k.origin, k.process) == (189.5, 250, 75.8, True, "Kenya", "Washed")
    # Origin and process stand 2,000 characters down the description.
    assert (r.price, r.origin, r.process, r.url) == (None, "Rwanda", "Natural", "https://harbour.test/products/river")
    assert (g.available, g.per100, g.tags) == (False, None, "Brazil pulped natural " + " ".join(["x"] * 200))
    assert n.notes == "plum, cocoa nib" and n.currency == "NOK"


def test_long_tags_are_kept_whole(spark):
    body = json.dumps({"products": [{"handle": "h", "title": "Lot", "tags": ["t%03d" % i for i in range(150)], "variants": [{"price": "1", "grams": 10}]}]})
    landed = spark.createDataFrame([("S", "NO", "https://s.test//", "NOK", body)], "shop string, country string, url string, currency string, body string")
    row = feeds.normalise_shop_json(landed).first()
    assert row.tags.endswith("t149") and row.url == "https://s.test/products/h"


def test_sitemaps_are_followed_to_the_end(spark):
    """Five levels, a loop between two maps, and a map that is not followed."""
    def links(*urls):
        return "<urlset>" + "".join(f"<loc>\n{u}\n</loc>" for u in urls) + "</urlset>"

    base = "https://deep.test"
    maps = {"/sitemap_index.xml": links("shop-1.xml", "news.xml"), "/shop-1.xml": links("//deep.test/shop-2.xml", "/goods/one/"),
            "/shop-2.xml": links("/shop-3.xml", "/goods/one/", "/goods/two?x=1"), "/shop-3.xml": links("/shop-1.xml", "/shop-4.xml", "ftp://deep.test/items/f"),
            "/shop-4.xml": links(*[f"https://cdn.test/item/{i}" for i in range(100)], "/blog/shop/entry"), "/news.xml": links("/products/unseen")}
    landed = spark.createDataFrame([("d", base + u, b) for u, b in maps.items()], "shop string, url string, body string")
    shops = spark.createDataFrame([("d", base), ("none", "https://none.test")], "shop string, base string")
    rows = sitemaps.product_urls(landed, shops).collect()
    got = [r.url for r in sorted(rows, key=lambda r: (len(r.place), r.place))]
    assert got == ["https://deep.test/goods/one/", *[f"https://cdn.test/item/{i}" for i in range(100)]]
    assert sitemaps.product_urls(landed, shops, max_products=3).count() == 3
    assert sitemaps.product_urls(landed, shops, depth=2).count() == 1
    assert sitemaps.product_urls(landed, shops, max_sitemaps=4).count() == 1


def test_product_pages(spark):
    def page(data):
        return f'<html><head><script id="ld" type="application/ld+json">\n{data}\n</script></head></html>'

    whole = {"@type": "Product", "name": " Burundi Ngozi 1kg ", "description": "Flavor notes: fig, black tea", "image": {"url": "https://i.test/n.webp"},
             "offers": [{"price": 61, "priceCurrency": "eur", "availability": "Sold Out"}]}
    cases = {
        "whole": page(json.dumps(whole)),
        "list": page(json.dumps([{"@type": "BreadcrumbList"}, {"@type": "IndividualProduct", "name": "Lot 7", "description": "250 g bag", "offers": {"price": "12,000"}}])),
        "cut": page('{"@type": "Product", "name": "never closed"'),
        "nameless": page('{"@type": "Product", "offers": {"price": 3}}'),
        "other": page('{"@type": "Organization", "name": "Shop"}'),
    }
    pages = spark.createDataFrame([(f"https://s.test/x/{k}///", v) for k, v in cases.items()], "url string, body string").select(
        F.lit("S").alias("shop"), F.lit("FR").alias("country"), F.lit("chf").alias("currency"), "url", "body")
    rows = by_key(feeds.normalise_product_pages(pages))
    assert sorted(rows) == ["list", "whole"]
    w, li = rows["whole"], rows["list"]
    assert (w.title, w.price, w.currency, w.grams, w.available, w.origin, w.notes, w.image) == (
        "Burundi Ngozi 1kg", 61.0, "EUR", 1000, False, "Burundi", "fig, black tea", "https://i.test/n.webp")
    assert (li.price, li.currency, li.grams, li.available) == (12000.0, "CHF", 250, True)


def test_rss(spark):
    items = "".join(f"<item><title>N{i}</title><link>u{i}</link><description>{'word ' * 60}</description></item>" for i in range(12))
    body = ("<rss><channel><item><title><![CDATA[Raw & <b>]]></title><link>https://n.test/a</link><pubDate>Tue, 3 Dec 2024</pubDate>"
            "<description>&lt;i&gt;x&lt;/i&gt;&amp;nbsp;y</description></item><item><link>only</link></item>" + items + "</channel></rss>")
    landed = spark.createDataFrame([("f", body)], "feed string, body string")
    rows = articles.parse_rss(landed).orderBy("place").collect()
    assert [r.place for r in rows] == [1, *range(3, 15)] and len(rows[-1].excerpt) == 299
    assert (rows[0].title, rows[0].date, rows[0].excerpt) == ("Raw & <b>", "2024-12-03", "x y")
    cut = articles.parse_rss(landed, 4, 20).orderBy("place").collect()
    assert [r.place for r in cut] == [1, 2, 3, 4] and len(cut[-1].excerpt) == 20


def test_missing_files_are_empty(spark, tmp_path):
    assert dims.read_city_cache(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "cache.json").write_text('{"oslo|NO": [10.7, 59.9], "atlantis|XX": null}')
    assert {(r.city_key, r.lon) for r in dims.read_city_cache(spark, str(tmp_path / "cache.json")).collect()} == {("oslo|NO", 10.7), ("atlantis|XX", None)}


def test_run_and_publish(spark, tmp_path):
    products = landed_snapshot(spark, tmp_path)
    now = F.lit("2024-05-10 12:00:00").cast("timestamp")
    where = [str(tmp_path / x) for x in ("state", "events")]
    out = track.run(spark, products, now, *where, str(tmp_path / "site"))
    assert out["stats"].first().asDict() == {"products": 4, "in_stock": 3, "shops": 1}
    assert {r.key.split("::")[1] for r in out["events"].collect()} == {"kiambu", "river", "noted"} and out["push"].count() == 0
    assert out["digest"].first().content.count("\n<") == 3
    assert spark.read.json(str(tmp_path / "site" / "products")).count() == 4
    assert [r.last_seen for r in dims.read_state(spark, where[0]).collect()] and dims.read_state(spark, where[0]).count() == 4
    items = publish.publish_items(publish.curate(out["products"]), F.lit("2024-05-11").cast("date"))
    by = {r.key.split("::")[1]: r for r in items.collect()}
    assert (by["kiambu"].origin, by["kiambu"].per, by["kiambu"].year, by["gone"].per, by["gone"].grams_default) == ("ケニア", "250g", 2024, "250g", True)
    later = F.lit("2024-05-12 00:00:00").cast("timestamp")
    changed = products.withColumn("available", F.col("available") | F.col("key").endswith("::gone"))
    out = track.run(spark, changed, later, *where)
    row = out["push"].first()
    assert (row.tag, out["events"].count()) == ("restock", 4) and "Brazil" in row.body
    assert dims.read_state(spark, where[0]).count() == 4
    plan = out["events"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
