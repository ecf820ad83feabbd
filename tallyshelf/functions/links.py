"""Hosts and outgoing links of shops and items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.functions.lookup import look_up
from tallyshelf.functions.prefilter import let

DEFAULT_TRACKING = "utm_source=catalogue&utm_medium=referral&utm_campaign=go"

# What no search of a foreign shop finds.
_UNSEARCHABLE = r"[　-鿿＀-￯]"
#: Whatever in a name the words of a search leave out or change; the listed names are all unsearchable.
_CHANGED = rf"{_UNSEARCHABLE}|[(\x00-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F]|\x20\x20"


def host(url: Column) -> Column:
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/]+)", 1)
    return F.replace(name, F.lit("www."), F.lit(""))


def bare_host(url: Column) -> Column:
    """Host text for comparing shop lists: no scheme, outer slashes or ``www.``, lower case."""
    text = F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://", "")
    text = F.regexp_replace(text, r"^/+|/+$", "")
    return F.lower(F.replace(text, F.lit("www."), F.lit("")))


def toggle_www(url: Column) -> Column:
    pattern = r"^(https?://)(www\.)?(.+)"
    text = F.coalesce(url, F.lit(""))
    scheme, rest = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3)
    return (
        F.when(~text.rlike(pattern), "")
        .when(F.regexp_extract(text, pattern, 2) != "", F.concat(scheme, rest))
        .otherwise(F.concat(scheme, F.lit("www."), rest))
    )


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def add_query(url: Column, query: str) -> Column:
    return F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(query))


def shop_link(url: Column, tracking: str = DEFAULT_TRACKING) -> Column:
    return F.when(F.coalesce(url, F.lit("")) != "", add_query(with_scheme(url), tracking))


def map_link(name: Column, city: Column) -> Column:
    """Map search for a shop: coordinates are only city-level, so the name is searched."""
    place = F.nullif(F.regexp_replace(F.coalesce(city, F.lit("")), r"\s*/\s*", " "), F.lit(""))
    return F.concat(
        F.lit("https://www.google.com/maps/search/?api=1&query="),
        encode_component(F.concat_ws(" ", F.nullif(name, F.lit("")), place)),
    )


def encode_component(text: Column) -> Column:
    """Percent-encoding of a query value: blanks as %20, the marks ! ' ( ) ~ left alone."""
    encoded = F.url_encode(text)
    for code, char in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def search_words(name: Column, country: Column) -> Column:
    """Words to search an item by in its shop; empty when a foreign shop could not find them."""
    text = F.trim(F.coalesce(name, F.lit("")))
    names = sorted(rules.SEARCH_NAMES, key=len, reverse=True)

    def translated(foreign: Column) -> Column:
        # Cut the text around known names, translate those pieces, and join it again.
        marked = F.regexp_replace(foreign, f"({'|'.join(names)})", "\u0001$1\u0001")
        pieces = F.transform(
            F.split(marked, "\u0001"),
            lambda p: F.coalesce(F.concat(F.lit(" "), look_up(rules.SEARCH_NAMES, p), F.lit(" ")), p),
        )
        foreign = F.regexp_replace(F.array_join(pieces, ""), _UNSEARCHABLE, " ")
        return F.trim(F.regexp_replace(foreign, r"(?U)\s+", " "))

    def usable(foreign: Column) -> Column:
        return F.when(foreign.rlike(r"[A-Za-zÀ-ɏ]{3,}"), foreign).otherwise("")

    foreign = F.regexp_replace(text, r"\d+\s*位", " ")
    foreign = F.regexp_replace(foreign, r"[（(][^）)]*[）)]", " ")
    return (
        F.when(F.coalesce(country, F.lit("")) == "JP", text)
        .when(text.rlike(_CHANGED), let(translated(foreign), usable))
        .otherwise(usable(text))
    )


def link_kind(shop_url: Column, platform: Column, item_link: Column, words: Column) -> Column:
    return (
        F.when(F.coalesce(shop_url, F.lit("")) == "", "none")
        .when(F.coalesce(item_link, F.lit("")) != "", "direct")
        .when((platform == "Shopify") & (words != ""), "search")
        .otherwise("shop")
    )


def item_link(shop_url: Column, platform: Column, link: Column, words: Column,
              tracking: str = DEFAULT_TRACKING) -> Column:
    """Link to an item: its page, else a search in the shop, else the shop."""
    origin = F.regexp_extract(with_scheme(shop_url), r"^(https?://[^/?#]+)", 1)

    def search(found: Column) -> Column:
        query = F.concat(origin, F.lit("/search?q="), encode_component(found), F.lit("&type=product&"), F.lit(tracking))
        return F.when(link_kind(shop_url, platform, link, found) == "search", query)

    # Only an item without a page needs its words, which are found once.
    direct = link_kind(shop_url, platform, link, F.lit("")) == "direct"
    return F.when(direct, add_query(link, tracking)).otherwise(
        F.coalesce(F.when(platform == "Shopify", let(words, search)), shop_link(shop_url, tracking)))
