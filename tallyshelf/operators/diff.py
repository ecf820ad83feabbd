"""Changes between snapshots: ``new``, ``restock`` and ``soldout`` events, and the stock state.

Rules per key, in time order:

* first sight of an available row raises ``new``; of an unavailable row nothing
* unavailable to available raises ``restock`` if the row was out for ``min_oos_hours``; a shorter
  gap raises nothing but still moves the change time
* available to unavailable raises ``soldout``
* a key missing from a snapshot is left as it was

Equal keys inside one snapshot are reduced to the last one before the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.rounding import round_even
from tallyshelf.functions.status import seconds_between
from tallyshelf.operators.pick import latest_per_key
from tallyshelf.session import settle

EVENT_COLUMNS = ["key", "type", "ts", "oos_hours"]


def _hours(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 3600


def _marked_rows(snapshots: DataFrame, key: str, ts: str, available: str, order: str | None,
                 slice_days: float) -> DataFrame:
    """Rows with the running number of availability changes inside their (key, time slice)."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    rows = snapshots.select(
        F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(available).cast("boolean").alias("available"),
        F.floor(seconds / (slice_days * 86400)).alias("slice"),
        *([F.col(order).alias("_order")] if order else []),
    )
    by_slice = Window.partitionBy("key", "slice")
    if order:
        later = F.lead("ts").over(by_slice.orderBy("ts", "_order"))
        rows = rows.withColumn("_later", later).filter(F.col("_later").isNull() | (F.col("_later") != F.col("ts")))
        rows = rows.drop("_later", "_order")
    in_time = by_slice.orderBy("ts")
    before = F.lag("available").over(in_time)
    rows = rows.withColumn("changed", before.isNull() | (before != F.col("available")))
    return rows.withColumn(
        "step", F.sum(F.col("changed").cast("int")).over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    )


def _slice_summary(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row per (key, slice), with what the slices before it carry in.

    ``before`` (key, available, last_status_change) is what was known ahead of all rows; it takes
    part as one more, earliest slice.
    """
    summary = rows.groupBy("key", "slice").agg(
        F.min("ts").alias("first_ts"),
        F.min_by("available", "ts").alias("first_available"),
        F.min(F.when(F.col("step") == 2, F.col("ts"))).alias("second_ts"),
        F.max(F.when(F.col("changed") & (F.col("step") >= 2), F.col("ts"))).alias("inner_change"),
        F.max_by("available", "ts").alias("last_available"),
        F.max("ts").alias("last_ts"),
    )
    if before is not None:
        kinds = dict(summary.dtypes)
        known = before.select(
            F.col("key").cast(kinds["key"]).alias("key"), F.lit(-(2**62)).alias("slice"), F.col("available").alias("last_available"),
            F.col("last_status_change").cast(kinds["first_ts"]).alias("inner_change"),
        )
        summary = summary.unionByName(known, allowMissingColumns=True)
    over_slices = Window.partitionBy("key").orderBy("slice")
    earlier = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.lag("last_available").over(over_slices)
    return (
        summary.withColumn("carried", carried)
        .withColumn("first_changed", F.col("carried").isNull() | (F.col("carried") != F.col("first_available")))
        .withColumn("change", F.coalesce("inner_change", F.when(F.col("first_changed"), F.col("first_ts"))))
        .withColumn("carried_change", F.last("change", ignorenulls=True).over(earlier))
        .filter(F.col("first_ts").isNotNull())
    )


def _restock(ts: Column, since: Column, min_oos_hours: float) -> Column:
    gap = _hours(since, ts)
    event = F.struct(
        F.lit("restock").alias("type"), ts.alias("ts"), round_even(gap, 1).alias("oos_hours")
    )
    return F.when(gap >= min_oos_hours, event)


def _plain(kind: str, ts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), ts.alias("ts"), F.lit(None).cast("double").alias("oos_hours"))


def snapshot_diff(snapshots: DataFrame, key: str = "key", ts: str = "ts", available: str = "available",
                  min_oos_hours: float = 12, order: str | None = None, slice_days: float = 1,
                  before: DataFrame | None = None) -> DataFrame:
    """All events of a history of snapshots: columns key, type, ts, oos_hours.

    ``before`` is the state the history continues: key, available, last_status_change.

    The history of a key is cut into time slices, which are compared apart; only a short row per
    slice travels on to link the slices. A key that holds a third of all rows is thus spread over
    its time line, and the rows themselves are shuffled once. Shorter slices spread a busy key
    further, at the price of more rows per slice summary.
    """
    rows = _marked_rows(snapshots, key, ts, available, order, slice_days)

    # From the third change of a slice on, everything needed is inside the slice.
    changes = rows.filter(F.col("changed"))
    in_time = Window.partitionBy("key", "slice").orderBy("ts")
    inner = (
        changes.withColumn("since", F.lag("ts").over(in_time))
        .filter(F.col("step") >= 3)
        .withColumn("event", F.when(F.col("available"), _restock(F.col("ts"), F.col("since"), min_oos_hours))
                    .otherwise(_plain("soldout", F.col("ts"))))
        .filter(F.col("event").isNotNull())
        .select("key", "event")
    )

    # The first two changes depend on what earlier slices left behind.
    s = _slice_summary(rows, before)
    first, second = F.col("first_available"), F.col("second_ts")
    first_event = (
        F.when(F.col("carried").isNull() & first, _plain("new", F.col("first_ts")))
        .when(F.col("carried").isNull() | ~F.col("first_changed"), None)
        .when(first, _restock(F.col("first_ts"), F.col("carried_change"), min_oos_hours))
        .otherwise(_plain("soldout", F.col("first_ts")))
    )
    since = F.when(F.col("first_changed"), F.col("first_ts")).otherwise(F.col("carried_change"))
    second_event = (
        F.when(second.isNull(), None)
        .when(~first, _restock(second, since, min_oos_hours))
        .otherwise(_plain("soldout", second))
    )
    heads = (
        s.select("key", F.explode(F.array(first_event, second_event)).alias("event"))
        .filter(F.col("event").isNotNull())
    )
    return inner.unionByName(heads).select("key", "event.type", "event.ts", "event.oos_hours")


def replay_state(snapshots: DataFrame, key: str = "key", ts: str = "ts", available: str = "available",
                 order: str | None = None, slice_days: float = 1, before: DataFrame | None = None) -> DataFrame:
    """Stock state after a history: key, available, first_seen, last_seen, last_status_change.

    Continuing ``before``, first_seen and last_status_change tell of the new rows only; the latter
    is null where they changed nothing.
    """
    s = _slice_summary(_marked_rows(snapshots, key, ts, available, order, slice_days), before)
    return s.groupBy("key").agg(
        F.max_by("last_available", "slice").alias("available"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
        F.max("change").alias("last_status_change"),
    )


def apply_snapshot(state: DataFrame, snapshot: DataFrame, now: Column, min_oos_hours: float = 12,
                   order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new state, events) of one snapshot taken at ``now``.

    The state has the snapshot's columns plus first_seen, last_seen and last_status_change, keyed
    by ``key``. Keys that are not in the snapshot keep their row. A row the state has already seen
    later than ``now`` is left alone.
    """
    if order:
        snapshot = latest_per_key(snapshot, ["key"], [F.col(order)]).drop(order)
    fields = [c for c in snapshot.columns if c != "key"]
    joined = state.alias("old").join(
        snapshot.withColumn("_seen", F.lit(True)).alias("new"), "key", "full_outer"
    )
    stale = F.col("old.last_seen").isNotNull() & (now < F.col("old.last_seen"))
    seen = F.coalesce(F.col("new._seen"), F.lit(False)) & ~F.coalesce(stale, F.lit(False))
    known = F.col("old.first_seen").isNotNull()
    is_available, was_available = F.col("new.available"), F.col("old.available")
    flipped = ~known | (is_available != was_available)

    new_state = joined.select(
        "key",
        *[F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in state.columns
          else F.when(seen, F.col(f"new.{c}")).alias(c) for c in fields],
        *[F.col(f"old.{c}").alias(c) for c in state.columns
          if c not in fields and c not in ("key", "first_seen", "last_seen", "last_status_change")],
        F.coalesce(F.col("old.first_seen"), now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("old.last_seen")).alias("last_seen"),
        F.when(seen & flipped, now).otherwise(F.col("old.last_status_change")).alias("last_status_change"),
    )
    event = (
        F.when(~known & is_available, _plain("new", now))
        .when(~known, None)
        .when(is_available & ~was_available, _restock(now, F.col("old.last_status_change"), min_oos_hours))
        .when(~is_available & was_available, _plain("soldout", now))
    )
    events = (
        joined.filter(seen).select("key", event.alias("event")).filter(F.col("event").isNotNull())
        .select("key", "event.type", "event.ts", "event.oos_hours")
    )
    return new_state, events


def _with_seen(state: DataFrame, snapshots: DataFrame) -> DataFrame:
    return snapshots.join(state.select("key", F.col("last_seen").alias("_seen")), "key", "left")


def late_rows(state: DataFrame, snapshots: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of snapshots older than what the state has seen of their key: (key, ts, last_seen)."""
    return _with_seen(state, snapshots).filter(F.col(ts) < F.col("_seen")).select("key", F.col(ts).alias("ts"), F.col("_seen").alias("last_seen"))


def apply_history(state: DataFrame, snapshots: DataFrame, ts: str = "ts", min_oos_hours: float = 12,
                  order: str | None = None, slice_days: float = 1) -> tuple[DataFrame, DataFrame]:
    """(new state, events) of several snapshots at once, the same as applying them one by one.

    ``snapshots`` has the product columns and the time of each row. Rows older than the key's
    stored ``last_seen`` are dropped; ``late_rows`` gives them. The number of snapshots does not matter:
    there is no loop.
    """
    fresh = settle(_with_seen(state, snapshots).filter(F.col("_seen").isNull() | (F.col(ts) >= F.col("_seen"))).drop("_seen"))
    before = state.select("key", "available", "last_status_change")
    events = snapshot_diff(fresh, "key", ts, "available", min_oos_hours, order, slice_days, before)
    marks = replay_state(fresh, "key", ts, "available", order, slice_days, before).drop("available")
    last = latest_per_key(fresh, ["key"], [F.col(ts), *([F.col(order)] if order else [])]).drop(ts, *([order] if order else []))
    new = last.join(marks, "key")
    fields = [c for c in last.columns if c != "key"]
    joined = state.alias("old").join(new.withColumn("_new", F.lit(True)).alias("new"), "key", "full_outer")
    seen = F.col("new._new").isNotNull()
    kept = [c for c in state.columns if c not in fields and c not in ("key", "first_seen", "last_seen", "last_status_change")]
    new_state = joined.select(
        "key",
        *[F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in state.columns
          else F.col(f"new.{c}").alias(c) for c in fields],
        *[F.col(f"old.{c}").alias(c) for c in kept],
        F.coalesce("old.first_seen", "new.first_seen").alias("first_seen"),
        F.coalesce("new.last_seen", "old.last_seen").alias("last_seen"),
        F.coalesce("new.last_status_change", "old.last_status_change").alias("last_status_change"),
    )
    return new_state, events


def recent_events(events: DataFrame, products: DataFrame, now: Column, days: float = 14,
                  limit: int | None = None) -> DataFrame:
    """Events of the last ``days`` with the attributes of their product, the newest ``limit`` if given.

    Of a log with an ``event_date`` only the day folders since then are read.
    """
    since = now - F.expr(f"make_dt_interval(0, 0, 0, {days * 86400})")
    fresh = events.filter(F.col("ts") > since)
    if "event_date" in events.columns:
        fresh = fresh.filter(F.col("event_date") >= F.to_date(since))
    listed = fresh.join(products, "key")
    return listed if limit is None else listed.orderBy(F.desc("ts"), "key").limit(limit)


def fresh_events(events: DataFrame, since: Column) -> DataFrame:
    """Events of this run worth a message."""
    fresh = events.filter((F.col("ts") > since) & F.col("type").isin("new", "restock"))
    return fresh.filter(F.col("event_date") >= F.to_date(since)) if "event_date" in events.columns else fresh


def event_counts(events: DataFrame, products: DataFrame) -> DataFrame:
    """Events by type, plus the products in stock under the name ``all``."""
    stock = products.agg(F.count_if("available").alias("n")).select(F.lit("all").alias("type"), "n")
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(stock)
