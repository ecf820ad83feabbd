"""Product addresses out of landed sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.operators.pick import earliest_per_key, top_per_group
from tallyshelf.session import settle

# Where to look, and what a product address looks like.
ROOTS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap_products_1.xml"]
PRODUCT_URL = r"(?i)/(?:products?|items?|goods|shop)/[^/?#]+/?$"
SKIPPED_URL = r"(?i)/(cart|account|login|search|blogs?|pages?|policies|collections)/"
FOLLOWED = r"(?i)product|item|shop|goods"


def resolve_url(base: Column, loc: Column) -> Column:
    """Absolute form of an address found in the document ``base``."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(https?://.*/)", 1)
    return (
        F.when(loc.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), loc)
        .when(loc.startswith("//"), F.concat(scheme, loc))
        .when(loc.startswith("/"), F.concat(origin, loc))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), loc))
    )


def _locations(documents: DataFrame) -> DataFrame:
    """Addresses of opened sitemaps with their place: (shop, path, loc)."""
    found = F.posexplode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("pos", "raw")
    rows = documents.select("shop", "url", "path", found)
    return rows.select(
        "shop", F.array_append("path", F.col("pos")).alias("path"), resolve_url(F.col("url"), F.col("raw")).alias("loc")
    ).filter(F.col("loc").rlike("^https?://"))


def product_urls(landed: DataFrame, shops: DataFrame, max_products: int | None = None,
                 max_sitemaps: int | None = None, depth: int | None = None) -> DataFrame:
    """Product addresses per shop: (shop, url, place); ``place`` sorts in order of discovery after its size.

    ``landed`` has shop, url, body; ``shops`` has shop and base address. Starting from the usual
    places, sitemaps are followed, until none is new or ``depth`` levels down, by joining their addresses
    to the landed documents. Each level is one equi-join on (shop, address); addresses asked for before
    are not followed again. ``max_products`` and ``max_sitemaps`` bound a shop, by default nothing does.
    """
    roots = F.array(*[
        F.struct(F.concat(F.regexp_replace("base", "/+$", ""), F.lit(r)).alias("url"), F.array(F.lit(i)).alias("path"))
        for i, r in enumerate(ROOTS)
    ])
    asked = settle(shops.select("shop", F.inline(roots)))
    documents = landed.select("shop", "url", "body")
    every_asked, every_found, level = asked, None, 0
    while True:
        found = settle(_locations(asked.join(documents, ["shop", "url"])))
        every_found = found if every_found is None else every_found.unionByName(found)
        level += 1
        if level == depth:
            break
        maps = found.filter(F.col("loc").endswith(".xml") & F.col("loc").rlike(FOLLOWED)).select("shop", F.col("loc").alias("url"), "path")
        asked = settle(earliest_per_key(maps, ["shop", "url"], [F.size("path"), F.col("path")]).join(
            every_asked.select("shop", "url"), ["shop", "url"], "left_anti"))
        if asked.isEmpty():
            break
        every_asked = every_asked.unionByName(asked)
    place = [F.size("path"), F.col("path")]
    found = every_found
    if max_sitemaps is not None:  # what the later sitemaps of a shop list does not count
        allowed = top_per_group(earliest_per_key(every_asked, ["shop", "url"], place), ["shop"], place, max_sitemaps)
        found = found.withColumn("parent", F.slice("path", F.lit(1), F.size("path") - 1)).join(
            allowed.select("shop", F.col("path").alias("parent")), ["shop", "parent"], "left_semi").drop("parent")
    wanted = found.filter(
        ~F.col("loc").endswith(".xml") & F.col("loc").rlike(PRODUCT_URL) & ~F.col("loc").rlike(SKIPPED_URL)
    )
    distinct = earliest_per_key(wanted, ["shop", "loc"], place)
    if max_products is not None:
        distinct = top_per_group(distinct, ["shop"], place, max_products)
    # The order of discovery is the path itself, so no shop's addresses are numbered in one task.
    return distinct.select("shop", F.col("loc").alias("url"), F.col("path").alias("place"))
