"""Entitlements folded from billing events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.status import plan_of
from tallyshelf.operators.pick import earliest_per_key

CHECKOUT = "checkout.session.completed"
UPDATED = "customer.subscription.updated"
DELETED = "customer.subscription.deleted"
PAID = "invoice.paid"
FIELDS = ["plan", "status", "current_period_end", "customer_id", "subscription_id"]


def once_per_event(events: DataFrame) -> DataFrame:
    """Deliveries may repeat; the first one of an event id counts."""
    return earliest_per_key(events, ["event_id"], [F.col("ts")])


def switches(checkouts: DataFrame, slice_days: float = 1) -> DataFrame:
    """Checkouts (user_id, ts, event_id, customer_id) that name another customer than the user's one before.

    Repeats are dropped inside (user, time slice) first, so a user with very many checkouts is never ordered
    whole. Switches and later checkouts together give the switches of all.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = checkouts.select("user_id", "ts", "event_id", "customer_id", F.floor(seconds / (slice_days * 86400)).alias("_slice"))

    def changes(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("ts", "event_id")
        first, before = F.row_number().over(order) == 1, F.lag("customer_id").over(order)
        kept = df.withColumn("_first", first).withColumn("_before", before)
        return kept.filter(F.col("_first") | ~F.col("_before").eqNullSafe(F.col("customer_id"))).drop("_first", "_before")

    return changes(changes(rows, "user_id", "_slice"), "user_id").drop("_slice")


def ownership(starts: DataFrame) -> DataFrame:
    """Spans in which a customer belongs to a user, of ``switches``: (_customer, _owner, _from, _to)."""
    per_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return starts.select(
        F.col("customer_id").alias("_customer"), F.col("user_id").alias("_owner"), F.col("ts").alias("_from"),
        F.lead("ts").over(per_user).alias("_to"),
    )


def with_user(events: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Add the user: named by a checkout, looked up by customer for later events.

    A customer belongs to a user from the checkout that names it until that user's next checkout
    names another one. Events of an unknown customer, and checkouts without user, are dropped.
    ``owned`` are the spans, if those of the events' own checkouts are not all.
    """
    checkouts = events.filter((F.col("type") == CHECKOUT) & F.col("user_id").isNotNull())
    owned = ownership(switches(checkouts)) if owned is None else owned
    later = events.filter(F.col("type") != CHECKOUT).drop("user_id")
    match = (
        (F.col("customer_id") == F.col("_customer")) & (F.col("ts") >= F.col("_from"))
        & (F.col("_to").isNull() | (F.col("ts") < F.col("_to")))
    )
    found = later.join(owned, match).withColumnRenamed("_owner", "user_id").drop("_customer", "_from", "_to")
    return checkouts.unionByName(found)


def changed_fields(events: DataFrame, plans_by_price: dict[str, str] | None = None) -> DataFrame:
    """What each event sets, as (user_id, ts, event_id, set fields); null means not set."""
    kind = F.col("type")
    plan = plan_of(F.col("price_id"), F.col("interval"), plans_by_price)
    one_off = (kind == CHECKOUT) & F.col("subscription_id").isNull()
    ignored = (kind == PAID) & F.col("subscription_id").isNull()

    def when(*cases: tuple[Column, Column]) -> Column:
        chain = F
        for test, value in cases:
            chain = chain.when(test, value)
        return chain

    return events.filter(~ignored).select(
        "user_id", "ts", "event_id",
        when((one_off, F.lit("premium_monthly")), (kind == DELETED, F.lit("free"))).otherwise(plan).alias("plan"),
        when((one_off, F.lit("active")), (kind == DELETED, F.lit("canceled"))).otherwise(F.col("status")).alias("status"),
        when((~one_off, F.col("current_period_end"))).alias("current_period_end"),
        when((kind == CHECKOUT, F.coalesce("customer_id", F.lit("")))).alias("customer_id"),
        when((one_off | (kind == PAID), F.lit(None))).otherwise(F.col("subscription_id")).alias("subscription_id"),
    )


def fold_entitlements(events: DataFrame, plans_by_price: dict[str, str] | None = None) -> DataFrame:
    """Entitlement row per user: the last value set per column.

    ``max_by`` per column is a partial aggregate, so a user with very many events costs one short
    row per task.
    """
    changes = changed_fields(with_user(once_per_event(events)), plans_by_price)
    when = F.struct("ts", "event_id")
    return changes.groupBy("user_id").agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), when)).alias(f) for f in FIELDS],
        F.max("ts").alias("updated_at"),
    )


def as_state(changes: DataFrame) -> DataFrame:
    """Changed fields as rows of state: each value that is set, and when it was."""
    when = F.struct("ts", "event_id")
    return changes.select("user_id", *[c for f in FIELDS for c in (F.col(f), F.when(F.col(f).isNotNull(), when).alias(f"{f}_at"))],
                          F.col("ts").alias("updated_at"))


def fold_state(states: DataFrame) -> DataFrame:
    """One row of state per user: of each field the value set last. States fold in any order and any grouping."""
    return states.groupBy("user_id").agg(
        *[c for f in FIELDS for c in (F.max_by(F.col(f), F.col(f"{f}_at")).alias(f), F.max(f"{f}_at").alias(f"{f}_at"))],
        F.max("updated_at").alias("updated_at"))
