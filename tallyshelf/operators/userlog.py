"""User logs: merging copies of a log, watch lists, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.classify import origin_group, process_class
from tallyshelf.operators.catalogue import reachable_shops
from tallyshelf.operators.pick import latest_per_key, top_per_group


def merge_lww(current: DataFrame, incoming: DataFrame, key: Sequence[str], at: str = "at") -> DataFrame:
    """Last writer wins per key; on equal times the incoming row wins.

    The winner's columns are laid over the other row: a column the incoming table does not have
    keeps its current value. A row without key is dropped, a missing time counts as 0.
    """
    keys = list(key)
    for k in keys:
        incoming = incoming.filter(F.col(k).isNotNull())
    stamp = F.coalesce(F.col(at), F.lit(0))
    mine = latest_per_key(current, keys, [stamp])
    theirs = latest_per_key(incoming, keys, [stamp])
    joined = mine.withColumn("_mine", F.lit(True)).alias("c").join(
        theirs.withColumn("_theirs", F.lit(True)).alias("i"), keys, "full_outer"
    )
    wins = F.col("i._theirs").isNotNull() & (
        F.col("c._mine").isNull() | (F.coalesce(F.col(f"i.{at}"), F.lit(0)) >= F.coalesce(F.col(f"c.{at}"), F.lit(0)))
    )
    columns = [c for c in current.columns if c not in keys]
    columns += [c for c in incoming.columns if c not in keys and c not in columns]

    def merged(name: str) -> Column:
        if name not in incoming.columns:
            return F.col(f"c.{name}")
        if name not in current.columns:
            return F.when(wins, F.col(f"i.{name}"))
        return F.when(wins, F.col(f"i.{name}")).otherwise(F.col(f"c.{name}"))

    return joined.select(*keys, *[merged(c).alias(c) for c in columns])


def merge_insert_only(current: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[Column],
                      group: Sequence[str] = ("user",), cap: int | None = None) -> DataFrame:
    """Current rows plus the incoming ones with a new key; the first ``cap`` by ``order`` per group if given."""
    keys = list(key)
    fresh = incoming.join(current.select(*keys), keys, "left_anti")
    rows = current.unionByName(fresh, allowMissingColumns=True)
    return rows if cap is None else top_per_group(rows, group, order, cap)


def import_history(current: DataFrame, backup: DataFrame, cap: int | None = None) -> DataFrame:
    """History lists after reading a backup: entries with a new time are added, the newest ``cap`` kept if given."""
    return merge_insert_only(current, backup, ["user", "at"], [F.desc("at")], cap=cap)


def import_backup(current: DataFrame, backup: DataFrame, keys: Sequence[str] = ("user", "item_id")) -> DataFrame:
    """Log after reading a backup: rows are added or refreshed, never removed."""
    return merge_lww(current, backup, keys)


def upsert_ratings(log: DataFrame, writes: DataFrame, keys: Sequence[str] = ("user", "item_id"),
                   order: Sequence[str] = ("at",)) -> DataFrame:
    """One row per item: the latest write replaces what is there."""
    return latest_per_key(log.unionByName(writes, allowMissingColumns=True), list(keys), [F.col(o) for o in order])


def sync(device: DataFrame, cloud: DataFrame, keys: Sequence[str] = ("user", "item_id")) -> DataFrame:
    """Both sides after a sync: the cloud is merged into the device, the result pushed back."""
    pulled = merge_lww(device, cloud, keys)
    return pulled.withColumn("at", F.coalesce("at", F.lit(0)))


def adopt_anonymous(log: DataFrame, anonymous: DataFrame, logins: DataFrame) -> DataFrame:
    """Rows of devices handed to accounts that have no rows of their own yet.

    ``logins`` has device and user, ``anonymous`` has device instead of user.
    """
    first_time = logins.join(log.select("user").distinct(), "user", "left_anti")
    adopted = anonymous.join(first_time, "device").drop("device")
    return log.unionByName(adopted, allowMissingColumns=True)


def watch_list(toggles: DataFrame, cap: int | None = None) -> DataFrame:
    """Watched items (user, item_id, at): an odd number of toggles; at most ``cap`` per user."""
    watched = (
        toggles.groupBy("user", "item_id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("at"))
        .filter(F.col("_n") % 2 == 1).drop("_n")
    )
    return watched if cap is None else top_per_group(watched, ["user"], [F.asc("at"), F.asc("item_id")], cap)


def back_in_stock(watches: DataFrame, items: DataFrame, shops: DataFrame) -> DataFrame:
    """Watched items that can be bought again."""
    live = items.filter(F.col("status") == "now").join(reachable_shops(shops).select("shop"), "shop", "left_semi")
    return watches.join(live.select(F.col("id").alias("item_id"), "shop", "name"), "item_id")


def with_items(log: DataFrame, items: DataFrame) -> DataFrame:
    """Log rows with their item's attributes; the origin written in the log wins."""
    item = items.select(
        F.col("id").alias("item_id"), F.col("origin").alias("_origin"), "process", "yen", F.lit(True).alias("matched")
    )
    return (
        log.join(item, "item_id", "left")
        .withColumn("origin", F.coalesce(F.nullif("origin", F.lit("")), F.col("_origin"), F.lit("")))
        .withColumn("matched", F.coalesce("matched", F.lit(False))).drop("_origin")
    )


def portfolio(joined: DataFrame, shops: DataFrame) -> DataFrame:
    """Figures per user: count, mean rating, shops, origins, spend over the matched items.

    ``joined`` comes from ``with_items``. Distinct shops and origins are counted as groups of
    groups, so no user's values are gathered in one place.
    """
    log = joined.join(shops.select("shop", F.lit(True).alias("_known")), "shop", "left")
    rated = F.coalesce("rating", F.lit(0)) != 0
    facets = log.groupBy(
        "user", F.when(F.col("_known"), F.col("shop")).alias("shop"), F.nullif("origin", F.lit("")).alias("origin")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(rated).alias("n_rated"),
        F.sum(F.when(rated, F.col("rating"))).alias("stars"),
        F.sum(F.when(F.col("matched"), F.col("yen"))).alias("spend"), F.count_if("matched").alias("n_priced"),
    )
    return facets.groupBy("user").agg(
        F.sum("n").alias("n"), F.sum("n_rated").alias("n_rated"), F.sum("stars").alias("stars"),
        F.countDistinct("shop").alias("n_shops"), F.countDistinct("origin").alias("n_origins"),
        F.sum("spend").alias("spend"), F.sum("n_priced").alias("n_priced"),
    ).withColumn(
        "mean_rating", F.coalesce(F.col("stars") / F.nullif("n_rated", F.lit(0)), F.lit(0.0))
    ).withColumn("spend", F.coalesce("spend", F.lit(0.0))).drop("stars")


def breakdown(joined: DataFrame) -> DataFrame:
    """Counts per user as (user, facet, value, n): origin, group, process, stars, shop."""
    def entry(facet: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value")))

    entries = F.array(
        entry("origin", F.nullif("origin", F.lit(""))),
        entry("group", origin_group(F.col("origin"))),
        entry("process", F.when(F.col("matched"), process_class(F.col("process")))),
        entry("stars", F.nullif("rating", F.lit(0))),
        entry("shop", F.col("shop")),
    )
    rows = joined.select("user", F.inline(F.filter(entries, lambda e: e.isNotNull())))
    return rows.groupBy("user", "facet", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, facet: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of a facet per user (5 shops, 8 origins)."""
    return top_per_group(counts.filter(F.col("facet") == facet), ["user"], [F.desc("n"), F.asc("value")], n, "place")


def favourites(log: DataFrame, n: int = 5) -> DataFrame:
    """Best-rated entries per user: four stars or more, newest first among equals."""
    good = log.filter(F.col("rating") >= 4)
    return top_per_group(good, ["user"], [F.desc("rating"), F.desc("at"), F.asc("item_id")], n, "place")


def activity_calendar(log: DataFrame, at: str, today: Column, weeks: int = 18,
                      group: Sequence[str] = ()) -> DataFrame:
    """Entries per day over ``weeks`` whole weeks, Sunday to the coming Saturday, zero-filled."""
    group = list(group)
    day = today.cast("date")
    end = F.date_add(day, 7 - F.dayofweek(day))
    start = F.date_sub(end, weeks * 7 - 1)
    in_range = F.col(at).cast("date").between(start, end)
    counts = log.filter(in_range).groupBy(*group, F.col(at).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spark = log.sparkSession
    if group:
        spine = log.select(*group).distinct()
    else:
        spine = spark.range(1).drop("id")
    spine = spine.select(*group, F.explode(F.sequence(start, end)).alias("day"))
    filled = spine.join(counts, [*group, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("future", F.col("day") > day)
