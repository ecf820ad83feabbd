"""Filtering, listing and counting a published catalogue.

Items have id, shop, name, origin, process, amount, cur, grams, status, updated_at and, where
used, notes, link and variety; shops have shop, name, city, country, region, url, platform, style.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.functions.classify import process_class
from tallyshelf.functions.price import believable, in_price_band, per100_yen, to_yen, yen_rate
from tallyshelf.functions.rounding import round_even, round_half_up
from tallyshelf.operators.pick import order_stats, top_per_group, upper_median


def with_unit_price(items: DataFrame, default_rate: float | None = None) -> DataFrame:
    """Add yen (price in yen) and p100 (yen per 100 g) from the fixed rate table."""
    rate = yen_rate(F.col("cur"), default_rate)
    return items.withColumn("yen", to_yen(F.col("amount"), rate)).withColumn(
        "p100", per100_yen(F.col("amount"), rate, F.col("grams"))
    )


def with_rates(items: DataFrame, fx: DataFrame, default_rate: float | None = None) -> DataFrame:
    """Add yen and p100 from a rate table (cur, jpy)."""
    rate = F.col("jpy") if default_rate is None else F.coalesce("jpy", F.lit(float(default_rate)))
    return (
        items.join(fx.select("cur", "jpy"), "cur", "left")
        .withColumn("yen", to_yen(F.col("amount"), rate))
        .withColumn("p100", per100_yen(F.col("amount"), rate, F.col("grams")))
        .drop("jpy")
    )


def rates_as_of(prices: DataFrame, fx: DataFrame, cur: str = "cur", at: str = "at",
                rate_date: str = "rate_date", rate: str = "jpy") -> DataFrame:
    """Add the latest rate dated on or before each price, null before the first rate.

    Rates are packed per (currency, month) with the rate carried in from earlier months, so prices
    are looked up by an equi-join on that pair, in place. Only (currency, month) pairs are ever
    ordered, never prices: a currency with a third of all prices is spread over its months, and
    the looked-up side is small enough for Spark to broadcast it once measured.
    """
    daily = (
        fx.select(F.col(cur).alias("_cur"), F.col(rate_date).cast("date").alias("_day"), F.col(rate).alias("_rate"))
        .groupBy("_cur", "_day").agg(F.max("_rate").alias("_rate"))
    )
    packed = daily.groupBy("_cur", F.trunc("_day", "month").alias("_month")).agg(
        F.array_sort(F.collect_list(F.struct("_day", "_rate"))).alias("_days")
    )
    asked = prices.select(F.col(cur).alias("_cur"), F.trunc(at, "month").alias("_month")).distinct()
    months = asked.join(packed, ["_cur", "_month"], "full_outer")
    earlier = Window.partitionBy("_cur").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_carried", F.last(F.element_at("_days", -1)["_rate"], ignorenulls=True).over(earlier))
    rows = prices.withColumn("_m", F.trunc(at, "month"))
    joined = rows.join(months, (F.col(cur) == F.col("_cur")) & (F.col("_m") == F.col("_month")), "left")
    due = F.filter("_days", lambda d: d["_day"] <= F.col(at).cast("date"))
    picked = F.coalesce(F.try_element_at(due, F.lit(-1))["_rate"], F.col("_carried"))
    return joined.withColumn(rate, picked).drop("_m", "_cur", "_month", "_days", "_carried")


def reachable_shops(shops: DataFrame) -> DataFrame:
    return shops.filter(F.coalesce("url", F.lit("")) != "")


def buyable(items: DataFrame, shops: DataFrame) -> DataFrame:
    """Items in stock at a shop that can be reached."""
    return items.filter(F.col("status") == "now").join(reachable_shops(shops).select("shop"), "shop", "left_semi")


def _contains(query: str, *columns: Column) -> Column:
    test = F.lit(False)
    for column in columns:
        test = test | F.lower(F.coalesce(column, F.lit(""))).contains(query)
    return test


def filter_items(items: DataFrame, shops: DataFrame, *, query: str = "", origin: str | None = None,
                 status: str = "all", process: str | None = None, price: str = "all") -> DataFrame:
    """Catalogue filter; ``None`` and ``all`` leave a criterion out, ``all`` still hides sold items.

    Needs the yen column. Keeps the shop's name and country as shop_name and shop_country.
    """
    kept = items.filter(F.col("status") != "sold" if status == "all" else F.col("status") == status)
    if origin is not None:
        kept = kept.filter(F.col("origin") == origin)
    if process is not None:
        kept = kept.filter(process_class(F.col("process")) == process_class(F.lit(process)))
    if price != "all":
        kept = kept.filter(in_price_band(price, F.col("yen")))
    dim = reachable_shops(shops).select(
        "shop", F.col("name").alias("shop_name"), F.col("country").alias("shop_country")
    )
    kept = kept.join(dim, "shop")
    text = query.strip().lower()
    if text:
        kept = kept.filter(
            _contains(text, F.col("name"), F.col("shop_name"), F.col("origin"), F.col("shop_country"))
        )
    return kept


def by_unit_price(ascending: bool = True, p100: str = "p100", tie: Sequence[str] = ("id",)) -> list[Column]:
    """Sort keys: unit price either way, unbelievable prices last both ways, ties by ``tie``."""
    price = F.col(p100)
    ok = believable(price)
    return [ok.desc(), price.asc_nulls_last() if ascending else price.desc_nulls_last(),
            *[F.col(t).asc() for t in tie]]


def by_date(ascending: bool = False, date: str = "updated_at", tie: Sequence[str] = ("id",)) -> list[Column]:
    """Sort keys: date either way, missing dates last both ways, ties in the same direction."""
    if ascending:
        return [F.col(date).asc_nulls_last(), *[F.col(t).asc() for t in tie]]
    return [F.col(date).desc_nulls_last(), *[F.col(t).desc() for t in tie]]


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a total order; a number past the end gives the last page.

    For a page or two of a small listing. One that is read often is written once by ``pages.write_pages``.
    """
    if number <= 0:
        return df.orderBy(*order).limit(size)
    last = max(0, -(-df.count() // size) - 1)
    return df.orderBy(*order).offset(min(number, last) * size).limit(size)


def now_counts(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status") == "now").groupBy("shop").agg(F.count(F.lit(1)).alias("n_now"))


def filter_shops(shops: DataFrame, items: DataFrame, query: str = "") -> DataFrame:
    """Shops matching a text, fullest stock first, then by name in locale order."""
    text = query.strip().lower()
    kept = shops.filter(_contains(text, F.col("name"), F.col("city"), F.col("country"))) if text else shops
    return (
        kept.join(now_counts(items), "shop", "left")
        .withColumn("n_now", F.coalesce("n_now", F.lit(0)))
        .orderBy(F.desc("n_now"), F.collate("name", "UNICODE"), "shop")
    )


def status_counts(items: DataFrame) -> DataFrame:
    """Items per shop in stock, sold and archived, in one pass."""
    return items.groupBy("shop").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("now", "sold", "archive")]
    )


def archive_years(items: DataFrame) -> DataFrame:
    """Archived items per shop and year, newest year first."""
    return (
        items.filter(F.col("status") == "archive")
        .groupBy("shop", F.year("updated_at").alias("year")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy("shop", F.desc("year"))
    )


UNIT_PRICE_BANDS = [("<1000", 0, 1000), ("1000-2000", 1000, 2000), ("2000-3000", 2000, 3000),
                    ("3000-5000", 3000, 5000), (">=5000", 5000, None)]


def overview(items: DataFrame, shops: DataFrame, bands=UNIT_PRICE_BANDS) -> DataFrame:
    """Catalogue figures as (section, name, n): totals, shops by region, items by process and band.

    Needs p100. Two passes, one over the shops and one over the items in stock. Figures that only
    count rows are conditional counts of that pass, so nothing but counters is shuffled.
    """
    reachable = reachable_shops(shops)
    regions = list(rules.REGION_COUNTRIES)
    region = F.when(F.col("region").isin(regions), F.col("region")).otherwise(rules.DEFAULT_REGION)
    shop_part = reachable.agg(
        F.count(F.lit(1)).alias("total|shops"),
        F.countDistinct("country").alias("total|countries"),
        *[F.count_if(region == r).alias(f"region|{r}") for r in regions],
    )
    kind = process_class(F.col("process"))
    paid = F.col("amount") > 0

    def in_band(low, high):
        test = paid & (F.col("p100") >= low)
        return test if high is None else test & (F.col("p100") < high)

    known_origin = F.when((F.col("origin") != rules.BLEND) & (F.col("origin") != ""), F.col("origin"))
    item_part = buyable(items, shops).agg(
        F.count(F.lit(1)).alias("total|now"),
        F.countDistinct(known_origin).alias("total|origins"),
        F.count_if(F.coalesce("notes", F.lit("")) != "").alias("total|notes"),
        F.count_if(paid).alias("total|priced"),
        *[F.count_if(kind == p).alias(f"process|{p}") for p in rules.PROCESS_ORDER],
        *[F.count_if(in_band(low, high)).alias(f"band|{name}") for name, low, high in bands],
    )

    def as_rows(one_row: DataFrame) -> DataFrame:
        entries = F.array(*[
            F.struct(F.lit(c.split("|")[0]).alias("section"), F.lit(c.split("|")[1]).alias("name"),
                     F.col(f"`{c}`").alias("n")) for c in one_row.columns
        ])
        return one_row.select(F.inline(entries))

    rows = as_rows(shop_part).unionByName(as_rows(item_part))
    return rows.filter((F.col("section") == "total") | (F.col("section") == "band") | (F.col("n") > 0))


def process_stats(items: DataFrame, shops: DataFrame, priced_only: bool = False) -> DataFrame:
    """Count, share and mean unit price per process class of the items in stock (needs p100).

    An item without a price counts as 0 in the mean, as in the published figures, unless
    ``priced_only``.
    """
    price = F.when(F.col("amount") > 0, F.col("p100")) if priced_only else F.col("p100")
    # Summed per process name first, so the patterns run on names and not on items.
    by_name = buyable(items, shops).groupBy("process").agg(
        F.count(F.lit(1)).alias("n"), F.sum(price).alias("_sum"), F.count(price).alias("_priced")
    )
    stats = by_name.groupBy(process_class(F.col("process")).alias("process_class")).agg(
        F.sum("n").alias("n"), (F.sum("_sum") / F.nullif(F.sum("_priced"), F.lit(0))).alias("mean_p100")
    )
    # At most one row per process class is left here.
    return stats.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def process_listing(items: DataFrame, shops: DataFrame, process_key: str, by_price: bool = True) -> DataFrame:
    """Items of one process class: cheapest first, or newest first (needs p100)."""
    rows = buyable(items, shops).filter(process_class(F.col("process")) == process_key)
    if by_price:
        return rows.orderBy(F.col("p100").asc_nulls_last(), "id")
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), F.desc("id"))


def coordinate_medians(points: DataFrame) -> DataFrame:
    """Rounded upper median of x and y per process class; points have process_class, x, y.

    Both axes are stacked into one column, so the points are worked out once.
    """
    axes = F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("value")) for axis in ("x", "y")])
    stats = order_stats(points.select("process_class", F.inline(axes)), ["process_class", "axis"], "value",
                        {"median": upper_median})
    rounded = round_half_up(F.col("median"))
    return stats.groupBy("process_class").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("axis") == "x", rounded)).alias("med_x"),
        F.max(F.when(F.col("axis") == "y", rounded)).alias("med_y"),
    )


def map_points(located: DataFrame, shops: DataFrame, process_key: str | None = None,
               notes_only: bool = False) -> DataFrame:
    """Items in stock to draw: optionally one process class, optionally only points from notes."""
    points = buyable(located, shops).withColumn("process_class", process_class(F.col("process")))
    if process_key:
        points = points.filter(F.col("process_class") == process_key)
    return points.filter(F.col("source") == "notes") if notes_only else points


def rare_ladder(items: DataFrame, shops: DataFrame, limit: int | None = 10) -> DataFrame:
    """Cheapest lots per rare category, with the number of lots a plan limit hides.

    Needs p100, variety, award, estate. An item may be in several categories. Unusable prices
    (below 1 yen) come last. ``limit=None`` shows everything.
    """
    categories = F.filter(
        F.array(
            F.when(F.col("variety") == "geisha", "geisha"),
            F.when(F.col("variety") == "sidra", "sidra"),
            F.when(F.col("award") | F.col("name").rlike(r"COE\s*\d+位"), "award"),
            F.when(F.col("estate"), "estate"),
        ),
        lambda c: c.isNotNull(),
    )
    lots = (
        buyable(items, shops).filter(F.col("amount") > 0)
        .withColumn("category", F.explode(categories))
        .withColumn("usable", F.coalesce(F.col("p100") >= 1, F.lit(False)))
    )
    # Counting apart keeps the ranking free of a whole-group window, so tasks can cut to the limit.
    totals = lots.groupBy("category").agg(F.count(F.lit(1)).alias("n_category"))
    order = [F.desc("usable"), F.col("p100").asc_nulls_last(), F.col("id").asc()]
    shown = lots if limit is None else top_per_group(lots, ["category"], order, limit, rank="place")
    locked = F.lit(0) if limit is None else F.greatest(F.lit(0), F.col("n_category") - limit)
    return shown.join(totals, "category").withColumn("locked", locked.cast("bigint"))


def site_rows(products: DataFrame, events: DataFrame, tab: str, *, shop: str | None = None,
              origin: str | None = None, query: str = "", sort: str = "newest",
              limit: int = 200) -> DataFrame:
    """Rows of the plain listing: products in stock (tab ``all``) or events of one type."""
    if tab == "all":
        rows = products.filter("available").withColumn("at", F.col("last_seen"))
    else:
        rows = events.filter(F.col("type") == tab).withColumn("at", F.col("ts"))
    if shop is not None:
        rows = rows.filter(F.col("shop") == shop)
    if origin is not None:
        rows = rows.filter(F.col("origin") == origin)
    text = query.strip().lower()
    if text:
        parts = [F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
                 for c in ("title", "shop", "origin", "process", "tags")]
        rows = rows.filter(F.lower(F.concat_ws(" ", *parts)).contains(text))
    order = {
        "cheap": F.coalesce("per100", F.lit(1e9)).asc(),
        "pricey": F.coalesce("per100", F.lit(-1.0)).desc(),
        "newest": F.col("at").desc(),
    }[sort]
    return rows.orderBy(order, "key").limit(limit)


def filter_values(products: DataFrame) -> DataFrame:
    """Sorted distinct shops and non-empty origins, as (field, value)."""
    shops = products.select(F.lit("shop").alias("field"), F.col("shop").alias("value"))
    origins = products.select(F.lit("origin").alias("field"), F.col("origin").alias("value"))
    rows = shops.unionByName(origins).filter(F.coalesce("value", F.lit("")) != "").distinct()
    return rows.orderBy(F.desc("field"), "value")


def site_stats(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count(F.lit(1)).alias("products"), F.count_if("available").alias("in_stock"),
        F.countDistinct("shop").alias("shops"),
    )


def notes_coverage(products: DataFrame) -> DataFrame:
    """Products with a note and their share in percent, 0 when there are none."""
    noted = F.count_if(F.trim(F.coalesce("notes", F.lit(""))) != "")
    total = F.count(F.lit(1))
    return products.agg(total.alias("products"), noted.alias("noted")).withColumn(
        "pct", F.coalesce(round_even(F.col("noted") / F.nullif("products", F.lit(0)) * 100, 1), F.lit(0.0))
    )
