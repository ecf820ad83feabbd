"""Text of a product: markup to lines, tasting notes, sizes, normalised titles and names."""

from __future__ import annotations

import html as html_lib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyshelf.functions import rules
from tallyshelf.functions.prefilter import let

_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
_NOTE_TRIM = " .．、,:：-–—/|"


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip(text: Column) -> Column:
    """Drop white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def html_lines(html: Column) -> Column:
    """Non-empty lines of an HTML fragment, as an array."""
    text = F.coalesce(html, F.lit(""))
    text = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?iU)<\s*(br|/p|/div|/li|/tr|/h[1-6])\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?is)<[^>]+>", " ")
    text = _replace_all(text, _ENTITIES)
    text = F.regexp_replace(text, "[ \t　]+", " ")
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def html_to_text(html: Column) -> Column:
    return F.array_join(html_lines(html), "\n")


def strip_tags(text: Column, by: str = "") -> Column:
    return F.regexp_replace(text, r"<[^>]+>", by)


def plain_excerpt(html: Column, limit: int | None = None) -> Column:
    """One line without markup, cut to ``limit`` characters if given."""
    text = strip_tags(F.coalesce(html, F.lit("")), " ")
    text = _replace_all(text, _ENTITIES[:5])
    line = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.substring(line, 1, limit) if limit else line


def clean_note(text: Column, limit: int | None = None) -> Column:
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(_NOTE_TRIM))
    text = F.regexp_replace(text, r"(?iU)^(and|of)\s+", "")
    text = F.regexp_replace(text, "[ \t　]+", " ")
    return F.substring(text, 1, limit) if limit else text


def notes_from_lines(lines: Column, limit: int | None = None) -> Column:
    """Tasting note in the lines of a description, cut to ``limit`` characters if given, empty if there is none.

    A labelled line wins (a label alone takes the next line); otherwise the first line of 5 to 90
    characters naming two different flavour words.
    """
    def note(ls: Column) -> Column:
        def labelled(line: Column, i: Column) -> Column:
            def complete(value: Column) -> Column:
                following = F.get(ls, i + 1)
                return F.when((F.length(value) < 3) & following.isNotNull(), clean_note(following, limit)).otherwise(value)

            def usable(value: Column) -> Column:
                return F.when((F.length(value) >= 3) & value.rlike(rules.NOTE_WORDS), value)

            value = let(clean_note(F.regexp_extract(line, rules.NOTE_LABEL, 1), limit), complete)
            return F.when(line.rlike(rules.NOTE_LABEL), let(value, usable))

        def words(line: Column) -> Column:
            return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(rules.NOTE_WORDS), 0), F.lower))

        by_label = F.get(F.filter(F.transform(ls, labelled), lambda v: v.isNotNull()), 0)
        short_line = F.get(F.filter(ls, lambda l: F.length(l).between(5, 90) & (F.size(words(l)) >= 2)), 0)
        return F.coalesce(by_label, clean_note(short_line, limit), F.lit(""))

    # A description without any flavour word cannot yield a note; skip the line work for it.
    return let(lines, lambda ls: F.when(F.exists(ls, lambda l: l.rlike(rules.NOTE_WORDS)), note(ls)).otherwise(""))


def extract_notes(html: Column, limit: int | None = None) -> Column:
    return notes_from_lines(html_lines(html), limit)


def grams_from_text(text: Column) -> Column:
    """First ``number kg|g`` of a text in whole grams, 0 when absent."""
    pattern = r"(?U)(\d+(?:\.\d+)?)\s*(kg|g)\b"
    low = F.lower(F.coalesce(text, F.lit("")))
    number = F.regexp_extract(low, pattern, 1).try_cast("double")
    grams = F.when(F.regexp_extract(low, pattern, 2) == "kg", number * 1000).otherwise(number)
    return F.coalesce(F.floor(grams).cast("int"), F.lit(0))


def first_listed(text: Column, words: list[tuple[str, str]]) -> Column:
    """Label of the first *listed* word the text contains, whatever its place in the text."""
    def first(low: Column) -> Column:
        rule = F
        for word, label in words:
            rule = rule.when(low.contains(word), F.lit(label))
        return rule.otherwise("")

    return let(F.lower(F.coalesce(text, F.lit(""))), first)


def guess_origin(text: Column) -> Column:
    return first_listed(text, [(w.lower(), w) for w in rules.ORIGINS])


def guess_process(text: Column) -> Column:
    return first_listed(text, rules.PROCESSES)


def guess_with_fallback(guess, text: Column, deep: Column) -> Column:
    """Guess from the short text, else from the long one."""
    return F.coalesce(F.nullif(guess(text), F.lit("")), guess(deep))


def fix_entities(title: Column) -> Column:
    return _replace_all(F.coalesce(title, F.lit("")), [("&#8211;", "-"), ("&#038;", "&"), ("&amp;", "&")])


def title_key(title: Column) -> Column:
    """Comparable form of a title: lower case, no blanks or punctuation, every script kept."""
    return F.regexp_replace(
        F.lower(F.coalesce(title, F.lit(""))), r"(?U)[\s　_\-\[\]（）()／/|、。,.:：!！’'\"]", ""
    )


def shop_key(name: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rules.SHOP_STOP_WORDS, "")
    return F.regexp_replace(low, "[^a-z0-9]", "")


def slug(name: Column, default: str = "shop", length: int = 24) -> Column:
    text = F.substring(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", ""), 1, length)
    return F.when(text != "", text).otherwise(default)


def has_letter(text: Column) -> Column:
    """A note counts only if it contains a letter of some script."""
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def unescape_html(text: Column) -> Column:
    """Full HTML entity decoding. Only texts with an ampersand reach Python; Spark has no built-in for the named entities."""
    # Built here, so that the function travels to executors by value.
    @F.pandas_udf(StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(html_lib.unescape, na_action="ignore")

    return F.coalesce(decode(F.when(text.contains("&"), text)), text)
