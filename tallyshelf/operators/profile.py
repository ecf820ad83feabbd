"""Shop profiles: tallies, shrunk shares, price trust, z-scores, odd prices, reasons.

Items here are those in stock at known shops, with shop, cur, origin, process, variety and p100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.classify import origin_group
from tallyshelf.functions.price import believable
from tallyshelf.functions.rounding import round_half_up
from tallyshelf.operators.pick import order_stats, top_per_group, upper_median
from tallyshelf.session import settle

PRIOR = 8
ORIGIN_SHARES = ["africa", "latam", "asia"]
STOCK_SHARES = ["clean", "natural", "experimental", "geisha"]
STYLE_FEATURES = ["light", "medium", "domestic"]
FEATURES = [*ORIGIN_SHARES, *STOCK_SHARES, *STYLE_FEATURES, "budget"]


_MARKS = ["n_origin", *ORIGIN_SHARES, "clean", "natural", "experimental"]


def _flag(test: Column) -> Column:
    return F.when(test, 1).otherwise(0)


def _marks(items: DataFrame) -> DataFrame:
    """What an item counts for, per distinct origin and process: (_origin, _process) and a number per entry of ``_MARKS``."""
    kinds = items.select(F.col("origin").alias("_origin"), F.col("process").alias("_process")).distinct()
    group, process = origin_group(F.col("_origin")), F.coalesce("_process", F.lit(""))

    def named(pattern: str) -> Column:
        return _flag(process.rlike("(?i)" + pattern))

    return kinds.select(
        "*", _flag(group.isNotNull()).alias("n_origin"), *[_flag(group == g).alias(g) for g in ORIGIN_SHARES],
        (named("Washed") - named(r"Anaerobic\s*Washed")).alias("clean"),
        (named("Natural|Honey") - named(r"Anaerobic\s*Natural")).alias("natural"),
        named("Anaerobic|Carbonic|Thermal|Yeast|Koji|Lactic").alias("experimental"),
    )


def shop_tally(items: DataFrame, order: str = "id") -> DataFrame:
    """Counts per shop, its currency (that of its first item) and upper median unit price.

    The items are read by three branches, so the columns these need are derived once. The patterns run
    on the distinct (origin, process), whose marks the items look up.
    """
    items = settle(items.select(*dict.fromkeys(["shop", "cur", "origin", "process", "variety", "p100", order])))
    marks = settle(_marks(items))
    marked = items.join(marks, F.col("origin").eqNullSafe(F.col("_origin")) & F.col("process").eqNullSafe(F.col("_process")))
    names = [*_MARKS, "geisha"]
    # Per currency first: sums and a number's minimum are added in place, a currency's name is not.
    by_currency = marked.withColumn("geisha", _flag(F.col("variety").isin("geisha", "sidra"))).groupBy("shop", "cur").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in names], F.min(order).alias("_first"))
    counts = by_currency.groupBy("shop").agg(
        F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in names], F.min_by("cur", "_first").alias("cur"))
    prices = order_stats(items.filter(believable(F.col("p100"))), ["shop"], "p100", {"price": upper_median}, "n_price")
    return counts.join(prices, "shop", "left").withColumn("price", F.coalesce("price", F.lit(0.0))).withColumn(
        "n_price", F.coalesce("n_price", F.lit(0))
    )


def price_trust(tally: DataFrame) -> DataFrame:
    """Add trusted: the shop's price is within a factor 3 of its currency peers.

    With fewer than three shops of a currency there is no one to compare with, so any known price
    is trusted.
    """
    shops_per_cur = tally.groupBy("cur").agg(F.count(F.lit(1)).alias("_shops"))
    peers = order_stats(tally.filter(F.col("price") != 0), ["cur"], "price", {"_peer": upper_median}, "_n").drop("_n")
    compared = tally.join(shops_per_cur.join(peers, "cur", "left"), "cur", "left")
    within = F.col("price").between(F.col("_peer") / 3, F.col("_peer") * 3)
    trusted = F.when(F.col("price") == 0, False).when(F.col("_shops") < 3, True).otherwise(within)
    return compared.withColumn("trusted", F.coalesce(trusted, F.lit(False))).drop("_shops", "_peer")


def _stock_rows(tally: DataFrame) -> DataFrame:
    """Long form (shop, feature, hits, den) of the share features."""
    entries = [
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("hits"),
                 F.col("n_origin" if f in ORIGIN_SHARES else "n").cast("double").alias("den"))
        for f in [*ORIGIN_SHARES, *STOCK_SHARES]
    ]
    return tally.select("shop", F.inline(F.array(*entries)))


def style_scores(style: Column, country: Column) -> dict[str, Column]:
    """Roast and home-market features, read from the shop's own text."""
    text = F.coalesce(style, F.lit(""))
    # Words of the style text and their scores.
    light = (F.when(text.rlike("極浅"), 1.0)
             .when(text.rlike("浅煎り"), F.when(text.rlike("中"), 0.7).otherwise(0.9))
             .when(text.rlike("中深|深"), 0.0).otherwise(0.4))
    medium = F.when(text.rlike("中浅|中煎り"), 1.0).when(text.rlike("浅〜中|浅/中"), 0.7).otherwise(0.4)
    return {"light": light, "medium": medium, "domestic": F.when(country == "JP", 1.0).otherwise(0.0)}


def feature_values(trusted: DataFrame, shops: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Long form (shop, feature, value) before standardising.

    Shares are pulled towards the share of the whole catalogue by ``prior`` average items. The
    price feature is the log distance from the median of the trusted shops, 0 if not trusted.
    """
    stock = _stock_rows(trusted)
    base = stock.groupBy("feature").agg((F.sum("hits") / F.sum("den")).alias("base"))
    shares = stock.join(base, "feature").select(
        "shop", "feature", ((F.col("hits") + prior * F.col("base")) / (F.col("den") + prior)).alias("value")
    )
    ok = trusted.filter("trusted").select(F.lit("budget").alias("feature"), "price")
    middle = order_stats(ok, ["feature"], "price", {"middle": upper_median}, "_n").drop("_n")
    budget = trusted.withColumn("feature", F.lit("budget")).join(middle, "feature", "left").select(
        "shop", "feature",
        F.coalesce(F.when(F.col("trusted"), -F.log2(F.col("price") / F.col("middle"))), F.lit(0.0)).alias("value"),
    )
    scores = style_scores(F.col("style"), F.col("country"))
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("value")) for f, c in scores.items()])
    text = trusted.select("shop").join(shops, "shop").select("shop", F.inline(entries))
    return shares.unionByName(budget).unionByName(text)


def z_scores(values: DataFrame) -> DataFrame:
    """Add z: distance from the mean in population standard deviations; no spread counts as 1."""
    spread = values.groupBy("feature").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    sd = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return values.join(spread, "feature").withColumn("z", (F.col("value") - F.col("_mean")) / sd).drop("_mean", "_sd")


def shop_profiles(items: DataFrame, shops: DataFrame, prior: float = PRIOR, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(profiles, tally): long (shop, feature, value, z) and one tally row per shop.

    The tables per shop are small and read by many branches, so each is computed once.
    """
    tally = settle(price_trust(settle(shop_tally(items, order))))
    return settle(z_scores(settle(feature_values(tally, shops, prior)))), tally


def odd_prices(prices: DataFrame, shop: str = "shop", unit_price: str = "p100", low: float = 200,
               high: float = 30000, min_n: int = 3) -> DataFrame:
    """Shops whose cheap end is too dear or whose dear end is too cheap, dearest first.

    A wrong currency or size shifts all prices of a shop alike, so the tenth from each end is
    looked at instead of the median. ``prices`` holds the priced, sized items in stock.
    """
    stats = order_stats(prices, [shop], unit_price, {
        "lo_end": lambda n: F.floor(n / 10),
        "hi_end": lambda n: n - 1 - F.floor(n / 10),
        "mid": upper_median,
    })
    odd = (F.col("lo_end") > high) | (F.col("hi_end") < low)
    return stats.filter((F.col("n") >= min_n) & odd).orderBy(F.desc("mid"), shop)


def reasons(picks: DataFrame, weights: DataFrame, profiles: DataFrame, tally: DataFrame, n: int = 2) -> DataFrame:
    """The up to ``n`` strongest reasons why a picked shop fits: (user, shop, reason).

    ``picks`` has user and shop, such as the result of ``score_shops``. A reason needs its fact to be well founded, a positive weight, and a z-score above 0.2.
    """
    def pct(part: str, whole: str) -> Column:
        value = round_half_up(F.col(part) / F.nullif(whole, F.lit(0)) * 100)
        return F.coalesce(value, F.lit(0)).cast("string")

    def entry(place: int, feature: str, text: Column, ok: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(feature).alias("feature"), text.alias("text"), ok.alias("ok"))

    # Wording of the reasons, and the order that breaks ties.
    facts = F.array(
        entry(0, "africa", F.concat(F.lit("アフリカ産が在庫の"), pct("africa", "n_origin"), F.lit("%")), F.col("n_origin") >= 4),
        entry(1, "latam", F.concat(F.lit("中南米産が在庫の"), pct("latam", "n_origin"), F.lit("%")), F.col("n_origin") >= 4),
        entry(2, "asia", F.concat(F.lit("アジア産が在庫の"), pct("asia", "n_origin"), F.lit("%")), F.col("n_origin") >= 4),
        entry(3, "natural", F.concat(F.lit("Natural・Honey が"), pct("natural", "n"), F.lit("%")), F.col("natural") > 0),
        entry(4, "clean", F.concat(F.lit("Washed が"), pct("clean", "n"), F.lit("%")), F.col("clean") > 0),
        entry(5, "experimental", F.concat(F.lit("Anaerobic など"), F.col("experimental"), F.lit("点")), F.col("experimental") > 0),
        entry(6, "geisha", F.concat(F.lit("ゲイシャ・シドラ"), F.col("geisha"), F.lit("点")), F.col("geisha") > 0),
        entry(7, "budget", F.concat(F.lit("100gあたり約"), F.format_number(round_half_up(F.col("price")), 0), F.lit("円")),
              F.col("trusted") & (F.col("price") > 0)),
    )
    founded = tally.select("shop", F.inline(facts)).filter("ok").drop("ok")
    strong = profiles.filter(F.col("z") > 0.2).select("shop", "feature", "z")
    wanted = weights.filter(F.col("weight") > 0).select("user", "feature", "weight")
    pairs = picks.select("user", "shop").join(wanted, "user").join(founded.join(strong, ["shop", "feature"]), ["shop", "feature"])
    best = top_per_group(
        pairs.withColumn("_pull", F.col("weight") * F.col("z")), ["user", "shop"],
        [F.desc("_pull"), F.asc("place")], n, rank="_place",
    )
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_place", "text"))), lambda r: r["text"]), " ・ "
    )
    return best.groupBy("user", "shop").agg(joined.alias("reason"))
