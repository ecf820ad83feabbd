"""Places: regions, country points, city keys, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.functions.lookup import look_up

EARTH_KM = 6371


def region_of(country: Column) -> Column:
    table = {c: region for region, codes in rules.REGION_COUNTRIES.items() for c in codes}
    return F.coalesce(look_up(table, country), F.lit(rules.DEFAULT_REGION))


def country_lon(country: Column) -> Column:
    return look_up({c: float(p[0]) for c, p in rules.COUNTRY_POINTS.items()}, country)


def country_lat(country: Column) -> Column:
    return look_up({c: float(p[1]) for c, p in rules.COUNTRY_POINTS.items()}, country)


def city_key(city: Column, country: Column) -> Column:
    return F.concat_ws(
        "|", F.lower(F.trim(F.coalesce(city, F.lit("")))), F.upper(F.trim(F.coalesce(country, F.lit(""))))
    )


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = (
        F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    )
    return F.asin(F.sqrt(a)) * (2 * EARTH_KM)


def names_a_country(city: Column, country: Column) -> Column:
    """The city field holds a country or state, so the place is not known."""
    return city.isin(rules.COUNTRY_NAMES) | (F.upper(city) == F.upper(country))
