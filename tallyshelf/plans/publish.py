"""From tracked products to the published catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions import classify, flavour, goods, links, price, rules
from tallyshelf.functions.prefilter import let
from tallyshelf.functions.rounding import round_even
from tallyshelf.functions.status import stock_status
from tallyshelf.functions.text import has_letter
from tallyshelf.operators import dims
from tallyshelf.operators.pick import once


def with_status(state: DataFrame, now: Column, archive_days: float = 14) -> DataFrame:
    """Add the stock status at ``now`` to a product state."""
    return state.withColumn(
        "status", stock_status(F.col("available"), F.col("last_status_change"), now, archive_days)
    )


def curate(products: DataFrame, excluded: Sequence[str] = goods.FEED_EXCLUDED,
           order: Sequence[str] = ("key",), max_live: int | None = None, max_past: int | None = None) -> DataFrame:
    """Products fit to publish: goods only, one per title and shop; with both limits, at most so many per shop."""
    live = (F.col("status") == "now") | F.col("available")
    goods = products.filter(classify.is_product(F.col("title"), F.col("grams"), excluded))
    place = [F.when(live, 0).otherwise(1), *[F.col(c) for c in order]]
    unique = dims.dedupe_by_title(goods, "shop", "title", place, "key")
    if max_live is None or max_past is None:
        return unique
    return dims.cap_per_group(unique, "shop", live, max_live, max_past, [F.col(c) for c in order])


def publish_items(products: DataFrame, today: Column) -> DataFrame:
    """Catalogue rows of curated products.

    Missing values take the published defaults (blend, Washed, 250 g, amount 0); the ``*_default``
    columns tell that apart from real ones. The id is a hash of the key and stays the same between
    runs.
    """
    origin = classify.origin_name(F.col("origin"))
    process = F.coalesce(F.col("process"), F.lit(""))
    name = F.coalesce(F.nullif("title", F.lit("")), F.lit("Lot"))
    seen = F.coalesce(F.to_date("first_seen"), today)
    notes = F.trim(F.coalesce("notes", F.lit("")))
    award = classify.is_award(F.col("title"))
    shown_origin = F.when(origin != "", origin).otherwise(rules.BLEND)
    return products.select(
        dims.stable_id("key").alias("id"), "key", "shop", name.alias("name"),
        shown_origin.alias("origin"), (origin == "").alias("origin_default"),
        F.when(process != "", process).otherwise("Washed").alias("process"), (process == "").alias("process_default"),
        round_even(F.coalesce("price", F.lit(0.0))).alias("amount"),
        F.coalesce(F.nullif("currency", F.lit("")), F.lit("JPY")).alias("cur"),
        price.pack_label(F.col("grams")).alias("per"), F.when(F.col("grams") > 0, F.col("grams")).otherwise(250).alias("grams"),
        (F.coalesce("grams", F.lit(0)) <= 0).alias("grams_default"),
        "status", F.year(seen).alias("year"), seen.alias("updated_at"),
        F.nullif("image", F.lit("")).alias("img"), F.nullif("url", F.lit("")).alias("link"),
        F.when(has_letter(notes), notes).alias("notes"),
        classify.variety(F.col("title"), F.col("tags")).alias("variety"), award.alias("award"),
        F.when(award, classify.award_rank(F.col("title"))).alias("award_rank"),
        classify.is_estate(F.col("title"), shown_origin).alias("estate"),
    )


def new_shops(products: DataFrame, seed: DataFrame, cities: DataFrame) -> DataFrame:
    """Shops of the products with their key; those not in the seed carry new metadata."""
    country = F.upper(F.coalesce(F.nullif("country", F.lit("")), F.lit("JP")))
    first = F.struct(country.alias("country"), F.trim(F.coalesce("city", F.lit(""))).alias("city"),
                     links.host(F.col("url")).alias("url"))
    live = F.when(F.col("available"), 0).otherwise(1)
    shops = products.groupBy(F.col("shop").alias("name")).agg(F.min_by(first, F.struct(live, F.col("key"))).alias("s"))
    matched = dims.match_seed_shops(shops.select("name", "s.country", "s.city", "s.url"), seed)
    placed = dims.place_shops(matched, cities)
    return placed.withColumn("city", F.when(F.col("city") != "", F.col("city")).otherwise(F.col("country")))


def shown_items(live: DataFrame, seed: DataFrame, excluded: Sequence[str] = goods.READER_EXCLUDED) -> DataFrame:
    """What the reader sees: live rows that pass the consumer-side rules, laid over the seed rows."""
    listed = live.filter(
        classify.is_listed_product(F.col("name"), excluded) & ~classify.is_wholesale(F.col("name"), F.col("grams"))
    )
    return dims.overlay_rows(seed, listed, "shop")


def locate(items: DataFrame, seed_column: str = "id", manual: DataFrame | None = None) -> DataFrame:
    """Add flavour coordinates x, y, family, source: from notes, else by hand, else a guess.

    ``manual`` has id, x, y, family for the few items placed by hand.
    """
    name, noted = F.coalesce(F.col("name"), F.lit("")), F.coalesce("notes", F.lit("")) != ""
    text = F.when(noted, F.concat_ws(" ", name, "notes")).otherwise(name)
    low = items.withColumn("_low", F.lower(text)).withColumn("_low_name", F.lower(name))
    scored = once(low, "_s", F.struct(
        flavour.score_struct(F.col("_low")).alias("text"),
        flavour.distinct_words(F.col("_low"), rules.FERMENT_WORDS).alias("ferment"),
    ))
    # The name is scored by itself only where notes are present but name no flavour.
    alone = noted & (flavour.total_score(F.col("_s.text")) == 0)
    by_name = flavour.score_struct(F.when(alone, F.col("_low_name")))
    seed = F.col(seed_column)
    # Inside lambdas: written out, the coordinates make a method that is too long for Java to compile.
    from_notes = let(F.col("_s"), lambda s: flavour.note_coordinates(F.col("notes"), seed, s["text"], s["ferment"]))
    named = F.when(alone, let(by_name, flavour.top_family)).otherwise(let(F.col("_s.text"), flavour.top_family))
    guess = let(named, lambda family: flavour.guessed_coordinates(F.col("process"), F.col("origin"), seed, family))
    if manual is None:
        point = F.coalesce(from_notes, guess)
    else:
        scored = scored.join(manual.select("id", F.struct(
            F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "family",
            F.lit("manual").alias("source")).alias("_manual")), "id", "left")
        point = F.coalesce(from_notes, F.col("_manual"), guess)
    return once(scored, "_p", point).select(*items.columns, "_p.x", "_p.y", "_p.family", "_p.source")
