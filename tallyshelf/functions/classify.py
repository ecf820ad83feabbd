"""Rule-based classes: process, origin, variety, award, product kind, platform.

A rule set is a list of patterns. Where only membership matters the patterns become one
alternation, so a row is scanned once; where the first match decides they become a ``when`` chain.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions import goods, rules
from tallyshelf.functions.lookup import look_up
from tallyshelf.functions.prefilter import alternatives, any_true, could_match, let, matches, matches_any
from tallyshelf.functions.text import fix_entities

_WORD = "[A-Za-z0-9_]"

# Fixed values.
DEFAULT_WHOLESALE = r"wholesale|卸売?|業務用|バルク|\bbulk\b|カートン|coffee ?sacks?|\bjute\b"
AWARD_EXEMPT = r"cup of excellence|\bcoe\b"


def ascii_boundaries(pattern: str) -> str:
    """Rewrite ``\\b`` to a boundary of ASCII words, next to which other scripts do not count.

    At the start of an alternative it looks behind, elsewhere ahead; in the rule sets a word
    character is always on the other side.
    """
    leading = re.sub(r"(^|[(|:])\\b", rf"\1(?<!{_WORD})", pattern)
    return leading.replace(r"\b", f"(?!{_WORD})")


def ascii_edges(pattern: str) -> str:
    """Rewrite ``\\b`` to an edge of ASCII words on either side, and ``\\s`` to white space of any script."""
    edge = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    return pattern.replace(r"\b", edge).replace(r"\s", r"[\s\p{Z}\x{FEFF}]")


#: Letters beyond ASCII that a pattern without case takes for letters of ASCII.
_ODD_LETTERS = "\u0130\u0131\u017f\u212a"


def _plain_low(text: Column) -> Column:
    """Lower-cased text to look for words in; null where letters are in it that patterns fold otherwise."""
    return F.when(~any_true([text.contains(c) for c in _ODD_LETTERS]), F.lower(text))


def _spelled(alternative: str) -> list[str]:
    """An alternative with its first group of plain words written out."""
    parts = re.fullmatch(r"([^()]*)\((\w+(?:\|\w+)+)\)(?![?*+{])(.*)", alternative)
    return [parts[1] + word + parts[3] for word in parts[2].split("|")] if parts else [alternative]


def _named(text: Column, pattern: str, low: Column | None = None) -> Column:
    """``text.rlike(pattern)``, tried only where a word is found that the pattern needs; ``low`` is the text's ``_plain_low``."""
    bare = re.sub(r"^\(\?\w+\)", "", pattern)
    parts = [a.lower() for part in alternatives(bare) for a in _spelled(part)]
    found = let(_plain_low(text), lambda x: could_match(x, parts)) if low is None else could_match(low, parts)
    return F.coalesce(found, F.lit(True)) & text.rlike(pattern)


def _size_at_least(text: Column, unit: str, minimum: float) -> Column:
    number = F.regexp_extract(text, rf"(?iU)(\d+(?:\.\d+)?)\s?{unit}\b", 1).try_cast("double")
    # Looking for the unit first spares most titles the pattern.
    return F.lower(text).contains(unit[:2]) & F.coalesce(number >= minimum, F.lit(False))


def is_product(title: Column, grams: Column, excluded: Sequence[str] = goods.FEED_EXCLUDED,
               exempt: str = rules.AWARD) -> Column:
    """Feed-side rule: award lots skip the word list, nothing skips the size limits."""
    # Written out: inside a lambda these long patterns would not be compiled into the query's code.
    text = fix_entities(title)
    listed = matches_any(F.lower(text), excluded, "(?U)") & ~text.rlike(exempt)
    rejected = listed | _size_at_least(text, "kg", 1) | _size_at_least(text, "lbs?", 2)
    return (F.coalesce(grams, F.lit(0)) < 1000) & ~rejected


def is_listed_product(name: Column, excluded: Sequence[str] = goods.READER_EXCLUDED) -> Column:
    """Consumer-side rule on the lower-cased name: award lots pass at once."""
    text = F.lower(fix_entities(name))
    return ~matches_any(text, excluded, edit=ascii_edges) | text.rlike(ascii_boundaries(AWARD_EXEMPT))


def is_wholesale(name: Column, grams: Column, words: str = DEFAULT_WHOLESALE) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    worded = matches(low, ascii_boundaries(words), [words], unicode=False) | _size_at_least(low, "kg", 1) | _size_at_least(low, "lbs?", 2)
    return (F.coalesce(grams, F.lit(0)) >= 1000) | worded


def skipped_type(product_type: Column) -> Column:
    low = F.lower(F.coalesce(product_type, F.lit("")))
    return low.rlike("|".join(rules.SKIPPED_PRODUCT_TYPES))


def process_class(process: Column) -> Column:
    text = F.coalesce(process, F.lit(""))
    chain = F
    for name, pattern in rules.PROCESS_CLASSES:
        chain = chain.when(text.rlike("(?i)" + pattern), name)
    return chain.otherwise("other")


def origin_name(origin: Column) -> Column:
    """Display name of an origin; unknown names pass through."""
    trimmed = F.trim(F.coalesce(origin, F.lit("")))
    return F.coalesce(look_up(rules.ORIGIN_NAMES, F.lower(trimmed)), trimmed)


def origin_group(origin: Column) -> Column:
    text = F.coalesce(origin, F.lit(""))
    chain = F
    for name, pattern in rules.ORIGIN_GROUPS:
        chain = chain.when(text.rlike(pattern), name)
    return chain


def variety(title: Column, tags: Column) -> Column:
    """``sidra`` or ``geisha``, null otherwise; a blend is never rare."""
    def rare(text: Column, low: Column) -> Column:
        return (
            F.when(_named(text, rules.BLEND_WORD, low), None)
            .when(_named(text, rules.SIDRA, low), "sidra")
            .when(_named(text, rules.GEISHA, low), "geisha")
        )

    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(tags, F.lit("")))
    return let(both, lambda text: let(_plain_low(text), lambda low: rare(text, low)))


def is_award(title: Column) -> Column:
    return _named(F.coalesce(title, F.lit("")), rules.AWARD)


def award_rank(title: Column) -> Column:
    """Rank 1 to 40 named in the title, else null."""
    text = F.coalesce(title, F.lit(""))
    # A generic expression uses its operands more than once; the variables of lambdas are found once.
    groups = F.array(*[F.regexp_extract(text, rules.AWARD_RANK, i) for i in (1, 2, 3)])
    named = F.get(F.filter(groups, lambda g: g != ""), 0).try_cast("int")
    return F.when(text.rlike(rules.AWARD_RANK), let(named, lambda rank: F.when(rank.between(1, 40), rank)))


def is_estate(title: Column, origin: Column) -> Column:
    """Lots of one estate: named outright, or by its farm when the origin agrees."""
    text = F.coalesce(title, F.lit(""))
    farm = _named(text, rules.ESTATE_FARM) & (
        (F.coalesce(origin, F.lit("")) == "コロンビア") | text.rlike("(?i)colombia")
    )
    return ~_named(text, rules.ESTATE_LOOKALIKE) & (_named(text, rules.ESTATE) | farm)


def platform(html: Column, limit: int | None = None) -> Column:
    """Shop platform by the first sign that occurs in a landed home page."""
    def first_sign(body: Column) -> Column:
        chain = F
        for name, pattern in rules.PLATFORM_SIGNS:
            chain = chain.when(body.rlike("(?i)" + pattern), name)
        return chain.otherwise("unknown")

    whole = F.coalesce(html, F.lit(""))
    return let(F.substring(whole, 1, limit) if limit else whole, first_sign)


def product_like_links(body: Column) -> Column:
    """Number of product-like ``<loc>`` entries of a sitemap."""
    locs = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)
    return F.size(F.filter(locs, lambda u: u.rlike("(?i)/(product|products|items|item|shop|goods|store)/")))


def structured_kinds(html: Column) -> Column:
    """Sorted distinct kinds of structured data blocks that describe goods."""
    blocks = F.regexp_extract_all(
        F.coalesce(html, F.lit("")),
        F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1,
    )
    goods = F.filter(blocks, lambda b: b.rlike(r'"@type"\s*:\s*"(Product|ItemList|Offer)"'))
    kinds = F.transform(goods, lambda b: F.regexp_extract(b, r'"@type"\s*:\s*"(\w+)"', 1))
    return F.array_sort(F.array_distinct(kinds))
