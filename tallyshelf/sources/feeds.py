"""Landed shop feeds to product rows: shop JSON, store-API JSON, Atom, product pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf import schemas
from tallyshelf.functions import text as X
from tallyshelf.functions.classify import skipped_type
from tallyshelf.functions.price import per100
from tallyshelf.functions.rounding import round_even
from tallyshelf.sources import xml_files


def _empty(*names: str) -> list[Column]:
    return [F.lit("").alias(n) for n in names]


def _finish(rows: DataFrame) -> DataFrame:
    """Columns derived the same way for every feed, in the product schema.

    Needs text (short) and lines (of the description) besides the plain product columns.
    """
    deep = F.concat_ws(" ", "text", F.array_join("lines", "\n"))
    rows = rows.withColumn("origin", X.guess_with_fallback(X.guess_origin, F.col("text"), deep))
    rows = rows.withColumn("process", X.guess_with_fallback(X.guess_process, F.col("text"), deep))
    rows = rows.withColumn("notes", X.notes_from_lines(F.col("lines")))
    for name in ("city", "province"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(""))
    return rows.select(*[F.col(n).cast(t).alias(n) for n, t in schemas.PRODUCT_FIELDS.items()])


def _tag_text(tags: Column) -> Column:
    """Tags may be a list or one string."""
    listed = F.try_variant_get(tags, "$", "array<string>")
    return F.coalesce(F.array_join(listed, " "), F.try_variant_get(tags, "$", "string"), F.lit(""))


def _pick_variant(variants: Column) -> tuple[Column, Column]:
    """(the first available variant else the first, whether any is available)."""
    available = F.filter(variants, lambda v: F.coalesce(v["available"], F.lit(False)))
    return F.coalesce(F.get(available, 0), F.get(variants, 0)), F.size(available) > 0


def read_snapshot(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Products of a folder of snapshot files, each a shop header with its products, or one such per line.

    The plain form: sizes come from the variant only, and a known size alone gives a unit price.
    """
    feed = spark.read.schema(schemas.SHOP_FEED).option("multiLine", not lines).json(path)
    rows = feed.select(F.col("_roaster").alias("r"), F.explode("products").alias("p"))
    variant, available = _pick_variant(F.col("p.variants"))
    rows = rows.withColumn("v", variant).withColumn("available", available)
    rows = rows.withColumn("text", F.concat_ws(" ", F.col("p.title"), _tag_text(F.col("p.tags"))))
    grams, price = F.coalesce(F.col("v.grams"), F.lit(0)), F.col("v.price").try_cast("double")
    return _finish(rows.select(
        F.concat_ws("::", "r.name", "p.handle").alias("key"), F.col("r.name").alias("shop"), "r.country", "p.title",
        F.concat("r.url", F.lit("/products/"), "p.handle").alias("url"), *_empty("image"),
        price.alias("price"), "r.currency", grams.alias("grams"),
        F.when(grams > 0, round_even(price / F.nullif(grams, F.lit(0)) * 100, 2)).alias("per100"),
        "available", "text", F.col("text").alias("tags"), X.html_lines(F.col("p.body_html")).alias("lines"),
    ))


def normalise_shop_json(landed: DataFrame) -> DataFrame:
    """Products of landed shop-JSON pages.

    ``landed`` has shop, country, url, currency, body and optionally city and province. Product
    types that are no goods and products without variants are left out.
    """
    place = [c for c in ("city", "province") if c in landed.columns]
    base = F.regexp_replace("url", "/+$", "")
    rows = (
        landed.withColumn("base", base)
        .withColumn("feed", F.from_json("body", schemas.SHOP_FEED))
        .select("shop", "country", "base", "currency", *place, F.explode("feed.products").alias("p"))
        .filter(~skipped_type(F.col("p.product_type")) & (F.coalesce(F.size("p.variants"), F.lit(0)) > 0))
    )
    variant, available = _pick_variant(F.col("p.variants"))
    title, handle = F.coalesce(F.col("p.title"), F.lit("")), F.coalesce(F.col("p.handle"), F.lit(""))
    rows = rows.withColumn("v", variant).withColumn("available", available)
    from_text = X.grams_from_text(F.concat_ws(" ", F.coalesce("v.title", F.lit("")), title))
    rows = (
        rows.withColumn("text", F.concat_ws(" ", title, _tag_text(F.col("p.tags"))))
        .withColumn("price", F.coalesce(F.col("v.price").try_cast("double"), F.lit(0.0)))
        .withColumn("grams", F.coalesce(F.nullif("v.grams", F.lit(0)), from_text))
    )
    return _finish(rows.select(
        F.concat(F.col("shop"), F.lit("::"), handle).alias("key"), "shop", "country", X.strip(title).alias("title"),
        F.concat(F.col("base"), F.lit("/products/"), handle).alias("url"),
        F.coalesce(F.get("p.images", F.lit(0))["src"], F.lit("")).alias("image"), "price", "currency", "grams",
        per100(F.col("price"), F.col("grams")).alias("per100"), "available", "text",
        F.col("text").alias("tags"), X.html_lines(F.col("p.body_html")).alias("lines"), *place,
    ))


def normalise_store_json(landed: DataFrame) -> DataFrame:
    """Products of landed store-API pages; prices come in minor units, stock defaults to true."""
    rows = (
        landed.withColumn("base", F.regexp_replace("url", "/+$", ""))
        .withColumn("p", F.explode(F.from_json("body", schemas.STORE_FEED)))
        .withColumn("title", X.strip(X.strip_tags(F.coalesce("p.name", F.lit("")))))
    )
    minor = F.coalesce("p.prices.currency_minor_unit", F.lit(2))
    price = F.coalesce(F.col("p.prices.price").try_cast("double"), F.lit(0.0)) / F.pow(F.lit(10.0), minor)
    rows = rows.withColumn("price", price).withColumn("grams", X.grams_from_text(F.col("title")))
    body = F.concat(
        F.coalesce("p.short_description", F.lit("")), F.lit("\n"), F.coalesce("p.description", F.lit(""))
    )
    return _finish(rows.select(
        F.concat_ws("::", "shop", F.col("p.id").cast("string")).alias("key"), "shop", "country", "title",
        F.coalesce("p.permalink", "base").alias("url"),
        F.coalesce(F.get("p.images", F.lit(0))["src"], F.lit("")).alias("image"), "price",
        F.coalesce(F.nullif("p.prices.currency_code", F.lit("")), "currency", F.lit("")).alias("currency"), "grams",
        per100(F.col("price"), F.col("grams")).alias("per100"),
        F.coalesce("p.is_in_stock", F.lit(True)).alias("available"), F.col("title").alias("text"),
        F.col("title").alias("tags"), X.html_lines(body).alias("lines"),
    ))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def normalise_atom(landed: DataFrame) -> DataFrame:
    """Products of landed Atom feeds; an entry is listed, hence in stock."""
    rows = (
        landed.withColumn("base", F.regexp_replace("url", "/+$", ""))
        .withColumn("e", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<entry>(.*?)</entry>"), 1)))
        .filter(F.col("e").rlike(r"(?s)<title>(.*?)</title>"))
        .withColumn("title", X.strip(X.unescape_html(X.strip_tags(F.regexp_extract("e", r"(?s)<title>(.*?)</title>", 1)))))
        .withColumn("summary", X.unescape_html(F.regexp_extract("e", r"(?is)<summary[^>]*>(.*?)</summary>", 1)))
        .withColumn("link", F.coalesce(_first(F.col("e"), r'<link[^>]*href="([^"]+)"'), F.col("base")))
        .withColumn("price", F.regexp_extract("e", r"<s:price[^>]*>([\d.]+)</s:price>", 1))
        .withColumn("priced_in", _first(F.col("e"), r'<s:price[^>]*currency="([^"]+)"'))
    )
    return _atom_products(rows)


ATOM_ENTRY = ("title struct<_VALUE: string, _type: string>, summary struct<_VALUE: string, _type: string>, "
              "link array<struct<_href: string>>, `s:price` struct<_VALUE: string, _currency: string>")


def read_atom(spark: SparkSession, path: str, shops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, broken entries) of Atom files in folders by shop (``shop=.../``), read entry by entry.

    ``shops`` has shop, country, url and currency, one row each; entries of other shops are left out. Broken are
    entries that are no XML: (shop, file, block, nth, element). Rules are those of ``normalise_atom``.
    """
    entries, broken = xml_files.parse_elements(xml_files.read_elements(spark, path, "entry"), ATOM_ENTRY)
    landed = shops.select("shop", "country", "currency", F.regexp_replace("url", "/+$", "").alias("base"))
    link = F.get(F.filter("x.link", lambda l: F.coalesce(l["_href"], F.lit("")) != ""), 0)["_href"]
    rows = entries.filter("x.title IS NOT NULL").join(landed, "shop").select(
        "shop", "country", "currency", "base", F.col("element").alias("e"),
        X.strip(X.strip_tags(xml_files.text_of(F.col("x.title._VALUE")))).alias("title"),
        xml_files.text_of(F.col("x.summary._VALUE")).alias("summary"), F.coalesce(link, "base").alias("link"),
        F.col("x")["s:price"]["_VALUE"].alias("price"), F.nullif(F.col("x")["s:price"]["_currency"], F.lit("")).alias("priced_in"))
    return _atom_products(rows), broken


def _atom_products(rows: DataFrame) -> DataFrame:
    """Products of entries with their source text ``e`` and what was read from it."""
    rows = rows.withColumn("price", F.coalesce(F.col("price").try_cast("double"), F.lit(0.0))).withColumn("grams", X.grams_from_text(F.col("title")))
    return _finish(rows.select(
        F.concat_ws("::", "shop", F.regexp_extract("link", r"([^/]*)$", 1)).alias("key"), "shop", "country", "title",
        F.col("link").alias("url"), F.regexp_extract("e", r'<img src="([^"]+)"', 1).alias("image"), "price",
        F.coalesce("priced_in", "currency", F.lit("")).alias("currency"), "grams", per100(F.col("price"), F.col("grams")).alias("per100"), F.lit(True).alias("available"),
        F.concat_ws(" ", "title", X.strip_tags(F.col("e"), " ")).alias("text"),
        F.col("title").alias("tags"), X.html_lines(F.col("summary")).alias("lines"),
    ))


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def structured_products(html: Column) -> Column:
    """Product objects of a page's structured data, in page order, as an array of variants.

    A block may be an object, a list, or an object with a graph; broken blocks are skipped.
    """
    blocks = F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), 1
    )
    items = F.flatten(F.filter(F.transform(blocks, lambda b: F.coalesce(
        _get(F.try_parse_json(b), "$", "array<variant>"),
        _get(F.try_parse_json(b), "$['@graph']", "array<variant>"),
        F.array(F.try_parse_json(b)),
    )), lambda list_: list_.isNotNull()))
    kind = lambda item: F.lower(F.coalesce(
        F.array_join(_get(item, "$['@type']", "array<string>"), " "), _get(item, "$['@type']"), F.lit("")))
    return F.filter(items, lambda item: kind(item).contains("product"))


def normalise_product_pages(pages: DataFrame) -> DataFrame:
    """One product per landed page with structured data; pages without it give no row.

    ``pages`` has shop, country, currency, url, body.
    """
    rows = pages.withColumn("ld", F.get(structured_products(F.col("body")), 0)).filter(F.col("ld").isNotNull())
    rows = rows.withColumn("offer", F.coalesce(
        _get(F.col("ld"), "$.offers[0]", "variant"), _get(F.col("ld"), "$.offers", "variant")))
    aggregate = F.lower(F.coalesce(_get(F.col("offer"), "$['@type']"), F.lit(""))) == "aggregateoffer"
    plain = _get(F.col("offer"), "$.price")
    price_text = F.when(aggregate, F.coalesce(_get(F.col("offer"), "$.lowPrice"), plain)).otherwise(plain)
    price = F.coalesce(F.replace(price_text, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
    availability = F.replace(F.lower(F.coalesce(_get(F.col("offer"), "$.availability"), F.lit(""))), F.lit(" "), F.lit(""))
    image = F.coalesce(
        _get(F.col("ld"), "$.image[0].url"), _get(F.col("ld"), "$.image[0]"), _get(F.col("ld"), "$.image.url"),
        _get(F.col("ld"), "$.image"), F.lit(""),
    )
    rows = (
        rows.withColumn("title", X.strip(F.coalesce(_get(F.col("ld"), "$.name"), F.lit(""))))
        .filter(F.col("title") != "")
        .withColumn("description", F.coalesce(_get(F.col("ld"), "$.description"), F.lit("")))
        .withColumn("price", price).withColumn("image", image)
        .withColumn("available", ~availability.contains("outofstock") & ~availability.contains("soldout"))
        .withColumn("cur", F.upper(F.coalesce(
            F.nullif(_get(F.col("offer"), "$.priceCurrency"), F.lit("")), "currency", F.lit(""))))
    )
    in_title = X.grams_from_text(F.col("title"))
    rows = rows.withColumn("grams", F.when(in_title > 0, in_title).otherwise(X.grams_from_text(F.col("description"))))
    last_part = F.regexp_extract(F.regexp_replace("url", "/+$", ""), r"([^/]*)$", 1)
    return _finish(rows.select(
        F.concat_ws("::", "shop", last_part).alias("key"), "shop", "country", "title", "url", "image", "price",
        F.col("cur").alias("currency"), "grams", per100(F.col("price"), F.col("grams")).alias("per100"), "available",
        F.col("title").alias("text"), F.col("title").alias("tags"),
        X.html_lines(F.col("description")).alias("lines"),
    ))


def failed_shops(asked: DataFrame, products: DataFrame) -> DataFrame:
    """Shops that were asked for but gave no product row."""
    return asked.select("shop").distinct().join(products.select("shop").distinct(), "shop", "left_anti")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds as one bag of product rows."""
    union = feeds[0]
    for feed in feeds[1:]:
        union = union.unionByName(feed, allowMissingColumns=True)
    return union
