"""Prices: conversion, unit price, price bands and money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.functions.lookup import look_up
from tallyshelf.functions.rounding import round_even, round_half_up

OUNCE_GRAMS = 28.35
UNKNOWN_SIZE = "250g"
# Range of believable yen per 100 g; anything outside was misread.
UNIT_PRICE_MIN, UNIT_PRICE_MAX = 100, 150000


def yen_rate(currency: Column, default: float | None = None) -> Column:
    rate = look_up({c: float(r) for c, r in rules.YEN_RATES.items()}, currency)
    return rate if default is None else F.coalesce(rate, F.lit(float(default)))


def to_yen(amount: Column, rate: Column) -> Column:
    return amount.cast("double") * rate


def per100(price: Column, grams: Column) -> Column:
    """Price per 100 in the shop's own currency, null when the price or size is unknown."""
    known = (grams > 0) & (price != 0)
    return F.when(known, round_even(price / F.nullif(grams, F.lit(0)) * 100, 2))


def pack_grams(per: Column) -> Column:
    """Grams of a pack label such as ``250g`` or ``12oz``, null when it has no number."""
    number = F.regexp_extract(per, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(per.endswith("oz"), round_half_up(number * OUNCE_GRAMS)).otherwise(
        F.floor(number).cast("bigint")
    )


def pack_label(grams: Column) -> Column:
    return F.when(grams > 0, F.concat(grams.cast("string"), F.lit("g"))).otherwise(UNKNOWN_SIZE)


def per100_yen(amount: Column, rate: Column, grams: Column) -> Column:
    return to_yen(amount, rate) / F.when(grams > 0, grams) * 100


def believable(unit_price: Column) -> Column:
    return F.coalesce(unit_price.between(UNIT_PRICE_MIN, UNIT_PRICE_MAX), F.lit(False))


def in_price_band(band: str, yen: Column) -> Column:
    """Membership of a price band; an unknown rate only passes ``all``."""
    tests = {
        "all": F.lit(True),
        "low": yen < 2000,
        "mid": (yen >= 2000) & (yen < 3000),
        "high": yen >= 3000,
    }
    return F.coalesce(tests[band], F.lit(False))


def display_class(unit_price: Column, process_class: Column) -> Column:
    return (
        F.when(unit_price >= 5000, "premium")
        .when(unit_price >= 3000, "midhigh")
        .otherwise(process_class)
    )


def format_yen(yen: Column, display: str = "JPY", usd_rate: float | None = None, usd_digits: int = 2) -> Column:
    if display == "JPY":
        return F.concat(F.lit("¥"), F.format_number(round_half_up(yen), 0))
    rate = rules.YEN_RATES["USD"] if usd_rate is None else usd_rate
    return F.concat(F.lit("$"), F.replace(F.format_number(yen / rate, usd_digits), F.lit(","), F.lit("")))


def format_local(amount: Column, currency: Column) -> Column:
    """Amount with the symbol of its currency, grouped, at most three decimals."""
    number = F.regexp_replace(F.regexp_replace(F.format_number(amount, 3), "0+$", ""), r"\.$", "")
    code = F.when(currency.isin("JPY", "USD"), "").otherwise(F.concat(F.lit(" "), currency))
    return F.concat(F.coalesce(look_up(rules.CURRENCY_SYMBOLS, currency), F.lit("")), number, code)
