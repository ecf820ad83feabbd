"""Stock status, freshness and plan predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions.lookup import look_up

DAY = 86400


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end as a double, with microseconds."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def stock_status(available: Column, changed_at: Column, now: Column, archive_days: float = 14) -> Column:
    """``now`` while in stock, ``sold`` after, ``archive`` once out of stock for ``archive_days``."""
    age_days = F.coalesce(seconds_between(changed_at, now), F.lit(0.0)) / DAY
    return F.when(available, "now").when(age_days >= archive_days, "archive").otherwise("sold")


def is_recent(updated_at: Column, now: Column) -> Column:
    """Added within the last day; up to an hour in the future is tolerated."""
    age = seconds_between(updated_at, now)
    return F.coalesce((age < DAY) & (age >= -3600), F.lit(False))


def plan_is_paid(plan: Column, status: Column, period_end: Column, now: Column) -> Column:
    """A paid plan, not cancelled and not past its period; missing fields do not disqualify."""
    active = F.coalesce(status, F.lit("")).isin("", "active", "trialing")
    in_period = period_end.isNull() | (now <= period_end)
    return F.coalesce(plan.startswith("premium"), F.lit(False)) & active & in_period


def plan_of(price_id: Column, interval: Column, plans_by_price: dict[str, str] | None = None) -> Column:
    """Plan by price id, else by billing interval."""
    by_interval = F.when(interval == "year", "premium_yearly").otherwise("premium_monthly")
    if not plans_by_price:
        return by_interval
    return F.coalesce(look_up(plans_by_price, price_id), by_interval)


def first_seen_date(first_seen: Column, today: Column) -> Column:
    """Date of an epoch-seconds text; a missing or broken value counts as today."""
    seconds = first_seen.try_cast("double")
    usable = (seconds != 0) & (F.abs(seconds) < 2.5e11)
    return F.coalesce(F.when(usable, F.to_date(F.timestamp_seconds(seconds))), today)


def repair_first_seen(first_seen: Column, last_seen: Column, notes: Column) -> tuple[Column, Column]:
    """(first_seen, notes) of a state row whose first_seen holds the note by mistake."""
    misplaced = first_seen.isNotNull() & first_seen.try_cast("double").isNull()
    return (
        F.when(misplaced, last_seen).otherwise(first_seen.try_cast("double")),
        F.when(misplaced, first_seen).otherwise(notes),
    )
