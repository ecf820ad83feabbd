"""Curating the catalogue: duplicates, caps, overlays, shop dimension, places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions import geo, rules
from tallyshelf.functions.text import shop_key, slug, title_key
from tallyshelf.operators.pick import earliest_per_key, latest_per_key, top_per_group


def dedupe_by_title(df: DataFrame, group: str, title: str, order: Sequence[Column], row_id: str) -> DataFrame:
    """One row per (group, normalised title), the first by ``order``; empty titles are all kept."""
    key = F.nullif(title_key(F.col(title)), F.lit(""))
    # A row without a usable title is its own group.
    own = F.coalesce(F.concat(F.lit("t"), key), F.concat(F.lit("r"), F.col(row_id).cast("string")))
    return earliest_per_key(df.withColumn("_title", own), [group, "_title"], order).drop("_title")


def cap_per_group(df: DataFrame, group: str, flag: Column, n_true: int, n_false: int,
                  order: Sequence[Column]) -> DataFrame:
    """At most ``n_true`` flagged and ``n_false`` other rows per group, the first by ``order``."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    ranked = top_per_group(marked, [group, "_flag"], order, max(n_true, n_false), rank="_place")
    return ranked.filter(F.col("_place") <= F.when(F.col("_flag"), n_true).otherwise(n_false)).drop("_flag", "_place")


def stable_id(*columns: str) -> Column:
    """Id that stays the same between runs, unlike a running number."""
    return F.xxhash64(*columns)


def overlay_rows(seed: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Seed rows of groups without live rows, plus all live rows."""
    covered = live.select(key).distinct()
    return seed.join(covered, key, "left_anti").unionByName(live, allowMissingColumns=True)


def overlay_dim(dims: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of dimension tables where the later table wins per key."""
    union = None
    for i, dim in enumerate(dims):
        ranked = dim.withColumn("_source", F.lit(i))
        union = ranked if union is None else union.unionByName(ranked, allowMissingColumns=True)
    return latest_per_key(union, [key], [F.col("_source")]).drop("_source")


def append_new(stored: DataFrame, current: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Stored rows as they are, plus the current rows whose key is not stored yet."""
    fresh = current.join(stored.select(key), key, "left_anti")
    if order:
        fresh = earliest_per_key(fresh, [key], order)
    return stored.unionByName(fresh, allowMissingColumns=True)


def merged_view(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Current rows, plus the stored rows they do not hide."""
    return current.unionByName(stored.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def match_seed_shops(shops: DataFrame, seed: DataFrame, name: str = "name") -> DataFrame:
    """Add key and matched: the seed's key on equal normalised names, else a slug of the name."""
    known = latest_per_key(
        seed.select(shop_key(F.col("name")).alias("_norm"), F.col("key").alias("_seed_key")),
        ["_norm"], [F.col("_seed_key")],
    )
    return (
        shops.withColumn("_norm", shop_key(F.col(name)))
        .join(known, "_norm", "left")
        .withColumn("matched", F.col("_seed_key").isNotNull())
        .withColumn("key", F.coalesce("_seed_key", slug(F.col(name))))
        .drop("_norm", "_seed_key")
    )


def place_shops(shops: DataFrame, cities: DataFrame) -> DataFrame:
    """Add lon, lat, region: the city's point, else the country's, else a default.

    ``cities`` has city_key, lon, lat; an entry with null coordinates means the city is known to be
    unknown.
    """
    points = cities.filter(F.col("lon").isNotNull()).select(
        "city_key", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")
    )
    has_city = F.trim(F.coalesce("city", F.lit(""))) != ""
    return (
        shops.withColumn("city_key", F.when(has_city, geo.city_key(F.col("city"), F.col("country"))))
        .join(points, "city_key", "left")
        .withColumn("lon", F.coalesce("_lon", geo.country_lon(F.col("country")), F.lit(rules.DEFAULT_POINT[0])))
        .withColumn("lat", F.coalesce("_lat", geo.country_lat(F.col("country")), F.lit(rules.DEFAULT_POINT[1])))
        .withColumn("region", geo.region_of(F.col("country")))
        .drop("_lon", "_lat", "city_key")
    )


def distinct_places(products: DataFrame) -> DataFrame:
    """Distinct (city, country) pairs with a city: trimmed, country in capitals."""
    return (
        products.select(F.trim(F.coalesce("city", F.lit(""))).alias("city"),
                        F.upper(F.coalesce("country", F.lit(""))).alias("country"))
        .filter(F.col("city") != "").distinct()
    )


def unresolved_cities(places: DataFrame, cities: DataFrame, limit: int | None = None) -> DataFrame:
    """Cities still to look up, the first ``limit`` if given; known-missing ones are not asked again."""
    asked = places.filter(F.trim(F.coalesce("city", F.lit(""))) != "").select(
        geo.city_key(F.col("city"), F.col("country")).alias("city_key")
    ).distinct()
    left = asked.join(cities.select("city_key"), "city_key", "left_anti")
    return left if limit is None else left.orderBy("city_key").limit(limit)


def countries_as_cities(shops: DataFrame) -> DataFrame:
    """Shops whose city field names a country or state."""
    return shops.filter(geo.names_a_country(F.col("city"), F.col("country")))


def latest_rates(payloads: DataFrame, defaults: DataFrame) -> DataFrame:
    """Current rate table (cur, jpy) from landed payloads laid over the defaults.

    ``payloads`` has priority and rates (map of currency to units per yen). The first source that
    yields any usable rate wins.
    """
    usable = (
        payloads.select("priority", F.explode("rates").alias("cur", "units"))
        .filter((F.col("units") > 0) & F.col("cur").isin(rules.LIVE_RATE_CURRENCIES))
    )
    first = usable.agg(F.min("priority").alias("priority"))
    live = usable.join(first, "priority").groupBy("cur").agg(F.max(1 / F.col("units")).alias("live"))
    return defaults.join(live, "cur", "full_outer").select("cur", F.coalesce("live", "jpy").alias("jpy"))


def first_prices(payloads: DataFrame, body: str = "body") -> DataFrame:
    """First price of each landed shop payload: (shop, first_price), as text.

    The price of the first product's first variant, '' where there is none, null where the payload is no JSON.
    """
    price = F.get_json_object(body, "$.products[0].variants[0].price")
    readable = F.try_parse_json(body).isNotNull()
    return payloads.select("shop", F.when(readable, F.coalesce(price, F.lit(""))).alias("first_price"))


def presentment_currency(plain: DataFrame, localised: DataFrame, shops: DataFrame) -> DataFrame:
    """Currency of each shop's feed: (shop, currency).

    ``shops`` has home, presentment and configured currency. Where home and presentment differ, the
    home currency counts only if asking for it changed the first price; a probe that is missing or
    unreadable (null) tells nothing.
    """
    probes = plain.select("shop", F.col("first_price").alias("_plain")).join(
        localised.select("shop", F.col("first_price").alias("_asked")), "shop"
    )
    home, shown = F.nullif("home", F.lit("")), F.nullif("presentment", F.lit(""))
    differ = home.isNotNull() & shown.isNotNull() & (home != shown)
    took_effect = F.coalesce(F.col("_plain") != F.col("_asked"), F.lit(False))
    return shops.join(probes, "shop", "left").select(
        "shop",
        F.when(differ, F.when(took_effect, home).otherwise(shown))
        .otherwise(F.coalesce(home, shown, F.coalesce("configured", F.lit("")))).alias("currency"),
    )


def shard(df: DataFrame, index: str, spec: str) -> DataFrame:
    """Every n-th row of a list from place i, for ``spec`` ``"i/n"``; ``index`` is the list place."""
    i, n = (int(part) for part in spec.split("/", 1))
    n = max(1, n)
    return df.filter(F.pmod(F.col(index), F.lit(n)) == i % n)


def position_check(points: DataFrame, reference: DataFrame, key: str, tolerance_km: float = 60) -> DataFrame:
    """Distance of each point from its reference point and a verdict: ok, far or missing.

    Points have lon, lat; the reference has ref_lon, ref_lat. Farthest first.
    """
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("ref_lon"), F.col("ref_lat"))
    return (
        points.join(reference.select(key, "ref_lon", "ref_lat"), key, "left")
        .withColumn("km", km)
        .withColumn("verdict", F.when(F.col("km").isNull(), "missing").when(F.col("km") > tolerance_km, "far")
                    .otherwise("ok"))
        .orderBy(F.col("km").desc_nulls_last())
    )


def probe_report(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """Per candidate shop: rows, in stock, priced and sized, currencies; zero for silent shops."""
    found = products.groupBy("shop").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("available").alias("n_available"),
        F.count_if(F.col("available") & (F.col("price") != 0) & (F.col("grams") > 0)).alias("n_priced"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("currency", F.lit("")))), "/").alias("currencies"),
    )
    return candidates.select("shop").join(found, "shop", "left").na.fill(0, ["n", "n_available", "n_priced"]).na.fill(
        "", ["currencies"]
    )


def platform_tally(shops: DataFrame) -> DataFrame:
    """Count of failed shops by platform plus overlapping flags, most common first.

    ``shops`` has fetched, platform, sitemap_links, structured.
    """
    name = F.when(F.col("fetched"), "fetched").otherwise(F.col("platform"))
    failed = ~F.col("fetched")
    labels = F.filter(
        F.array(name, F.when(failed & (F.col("sitemap_links") > 0), "*sitemap"),
                F.when(failed & (F.size("structured") > 0), "*structured")),
        lambda label: label.isNotNull(),
    )
    return (
        shops.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
    )
