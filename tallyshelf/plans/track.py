"""One tracking run: landed feeds to events, state and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.operators import catalogue, diff
from tallyshelf.operators.digest import long_digest, push_message
from tallyshelf.operators.pick import latest_per_key
from tallyshelf.plans.publish import with_status
from tallyshelf.sinks import tables
from tallyshelf.sinks.buckets import BucketTable


def run(spark: SparkSession, products: DataFrame, now: Column, state_path: str, events_path: str,
        export_path: str | None = None, min_oos_hours: float = 12) -> dict[str, DataFrame]:
    """Apply one snapshot and return the run's tables: products, events, stats, push, digest."""
    state = tables.product_state(spark, state_path)
    snapshot = latest_per_key(products, ["key"], [F.col("title"), F.col("url")])
    tables.take_snapshot(state, events_path, snapshot, now, min_oos_hours)
    return report(spark, state, events_path, now, export_path)


def report(spark: SparkSession, state: BucketTable, events_path: str, now: Column,
           export_path: str | None = None) -> dict[str, DataFrame]:
    products = with_status(state.read(), now)
    events = tables.read_events(spark, events_path)
    same = ["key", "type", "ts"]  # a run that failed half-way may have logged its events twice
    shown = products.drop("first_seen", "last_seen", "last_status_change")
    recent = diff.recent_events(events, shown, now).dropDuplicates(same)
    stats = catalogue.site_stats(products)
    if export_path:
        tables.export_site(products, recent, stats, export_path)
    fresh = diff.fresh_events(events, now - F.expr("interval 1 microsecond")).dropDuplicates(same).join(shown, "key")
    order = [-F.unix_micros("ts"), F.col("key")]
    return {
        "products": products, "events": recent, "stats": stats,
        "push": push_message(fresh, order), "digest": long_digest(fresh, [F.desc("ts"), F.asc("key")]),
    }
