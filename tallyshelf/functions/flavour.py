"""Flavour coordinates read from tasting notes, with a guess from process and origin behind them.

``x`` runs from clean (0) to characterful (100), ``y`` from bright (0) to deep (100).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.functions.classify import ascii_boundaries
from tallyshelf.functions.prefilter import by_re2, could_match

FAMILIES = [f[0] for f in rules.FLAVOUR_FAMILIES]


def distinct_words(low: Column, pattern: str) -> Column:
    """How many different words of a vocabulary occur in a lower-case text.

    RE2 counts the occurrences; only two or more have to be told apart.
    """
    found = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(ascii_boundaries(pattern)), F.lit(0))))
    plain, _, left = by_re2([pattern], unicode=False)
    if left:
        hint = could_match(low, pattern.split("|"))
        return found if hint is None else F.when(hint, found).otherwise(0)

    # Built here, so that the function travels to executors by value.
    @F.arrow_udf("int")
    def occurrences(values: pa.Array) -> pa.Array:
        return pc.count_substring_regex(values, plain).cast(pa.int32())

    count = F.coalesce(occurrences(low), F.lit(0))
    return F.when(count < 2, count).otherwise(found)


def score_struct(low: Column) -> Column:
    """Number of distinct words per family in a lower-case text, as one struct."""
    return F.struct(*[distinct_words(low, pattern).alias(name) for name, _, _, pattern in rules.FLAVOUR_FAMILIES])


def total_score(scores: Column) -> Column:
    return sum((scores[name] for name in FAMILIES), F.lit(0))


def top_family(scores: Column) -> Column:
    """Family with the highest score; the earlier family wins a tie, no score gives null."""
    best = F.greatest(*[scores[name] for name in FAMILIES])
    chain = F.when(best == 0, None)
    for name in FAMILIES:
        chain = chain.when(scores[name] == best, name)
    return chain


def _weighted(scores: Column, position: int) -> Column:
    total = sum((scores[f[0]] * F.lit(float(f[position])) for f in rules.FLAVOUR_FAMILIES), F.lit(0.0))
    return total / F.nullif(total_score(scores), F.lit(0))


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(4.0), F.least(F.lit(96.0), value))


def _jitter(seed: Column, factor: int) -> Column:
    # Reducing the seed first keeps the product small for any id.
    return F.pmod(F.pmod(seed, F.lit(21)) * factor, F.lit(21)) - 10


def note_coordinates(notes: Column, seed: Column, scores: Column, ferment: Column) -> Column:
    """Struct (x, y, family, source) from notes, null when the notes name no flavour."""
    spread = sum((F.when(scores[f] > 0, 1).otherwise(0) for f in FAMILIES), F.lit(0))
    amplitude = F.when(spread >= 3, 0.5).otherwise(0.25)
    x = F.lit(50.0) + _weighted(scores, 2) * 2.2 + F.least(F.lit(3), ferment) * 9
    y = F.lit(50.0) + _weighted(scores, 1) * 2.2
    return F.when(
        (F.coalesce(notes, F.lit("")) != "") & (total_score(scores) > 0),
        F.struct(
            _clamp(x + _jitter(seed, 53) * amplitude).alias("x"),
            _clamp(y + _jitter(seed, 97) * amplitude).alias("y"),
            top_family(scores).alias("family"),
            F.lit("notes").alias("source"),
        ),
    )


def guessed_coordinates(process: Column, origin: Column, seed: Column, named: Column) -> Column:
    """Struct (x, y, family, source) from process, origin and the top family ``named`` by the name."""
    process = F.coalesce(process, F.lit(""))
    origin = F.coalesce(origin, F.lit(""))

    def has(pattern: str) -> Column:
        return process.rlike("(?i)" + pattern)

    # Base position by process and by origin, family by origin and process.
    x = (F.when(has("Anaerobic"), 84.0).when(has("Natural"), 66.0).when(has("Honey"), 54.0)
         .otherwise(30.0))
    y = (F.when(origin.rlike("エチオピア|ケニア|ルワンダ|ブルンジ|タンザニア"), 24.0)
         .when(origin.rlike("コロンビア|グアテマラ|コスタリカ|パナマ"), 42.0)
         .when(origin.rlike("ペルー|メキシコ"), 55.0)
         .when(origin.rlike("ブラジル|インドネシア|インド|ベトナム|中国"), 72.0)
         .when(origin.rlike("ブレンド"), 62.0)
         .otherwise(48.0))
    wild = has("Natural|Anaerobic")
    family = (F.when(origin.rlike("エチオピア"), F.when(wild, "berry").otherwise("floral"))
              .when(origin.rlike("ケニア|タンザニア"), "berry")
              .when(origin.rlike("コロンビア|グアテマラ|コスタリカ|パナマ|ペルー"), "citrus")
              .when(origin.rlike("ブラジル|メキシコ|インドネシア|インド|ベトナム|中国"), "choco")
              .when(wild, "tropical")
              .otherwise("citrus"))

    def offset(position: int) -> Column:
        chain = F
        for row in rules.FLAVOUR_FAMILIES:
            chain = chain.when(named == row[0], float(row[position]))
        return chain.otherwise(0.0)

    return F.struct(
        _clamp(x + offset(2) + _jitter(seed, 53) * 0.9).alias("x"),
        _clamp(y + offset(1) + _jitter(seed, 97) * 0.9).alias("y"),
        F.coalesce(named, family).alias("family"),
        F.lit("guess").alias("source"),
    )
