"""Articles of an RSS feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.lookup import look_up
from tallyshelf.functions.text import plain_excerpt, strip, unescape_html
from tallyshelf.operators.pick import top_per_group
from tallyshelf.sources import xml_files

MONTHS = {m: f"{i:02d}" for i, m in enumerate(
    ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"], 1)}


def _element(item: str, tag: str):
    inner = F.regexp_extract(item, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    plain = F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")
    return strip(F.when(inner.rlike(r"^\s*<!\[CDATA\["), plain).otherwise(unescape_html(inner)))


def parse_rss(landed: DataFrame, limit: int | None = None, excerpt: int | None = None) -> DataFrame:
    """Articles per landed feed, the first ``limit`` if given: (feed, place, title, url, date, excerpt, image).

    An article needs a title and a link. An unknown month counts as January. Without a limit the place is
    the one in the feed, with it the rank among usable articles.
    """
    rows = landed.select(
        "feed", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), 1)).alias("pos", "item")
    )
    rows = rows.withColumn("title", _element("item", "title")).withColumn("url", _element("item", "link"))
    rows = rows.withColumn("published", _element("item", "pubDate")).withColumn("description", _element("item", "description"))
    image = F.coalesce(
        F.nullif(_element("item", "media:thumbnail"), F.lit("")),
        F.regexp_extract("item", r'<media:thumbnail[^>]*url="([^"]*)"', 1),
    )
    usable = _articles(rows.withColumn("image", image), excerpt)
    # The place inside the feed is known, so the first ones are found without ordering the rest.
    if limit is None:
        placed = usable.withColumn("place", F.col("pos") + 1)
    else:
        placed = top_per_group(usable, ["feed"], [F.col("pos")], limit, rank="place")
    return placed.select("feed", "place", "title", "url", "date", "excerpt", "image")


RSS_ITEM = ("title string, link string, pubDate string, description string, "
            "`media:thumbnail` struct<_VALUE: string, _url: string>")


def read_rss(spark: SparkSession, path: str, limit: int | None = None, excerpt: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, broken items) of RSS files, read item by item; the feed is the file.

    Articles are (feed, block, nth, title, url, date, excerpt, image), in the file's order by block and nth; with a
    limit the first ones of each file, and their ``place``. Broken are items that are no XML: (file, block, nth, element).
    """
    items, broken = xml_files.parse_elements(xml_files.read_elements(spark, path, "item"), RSS_ITEM)
    read = lambda name: strip(xml_files.text_of(F.col("x")[name]))
    thumbnail = F.col("x")["media:thumbnail"]
    rows = items.select(
        F.col("file").alias("feed"), "block", "nth", read("title").alias("title"), read("link").alias("url"), read("pubDate").alias("published"),
        read("description").alias("description"),
        F.coalesce(F.nullif(strip(xml_files.text_of(thumbnail["_VALUE"])), F.lit("")), thumbnail["_url"], F.lit("")).alias("image"))
    articles = _articles(rows, excerpt)
    if limit is not None:
        articles = top_per_group(articles, ["feed"], [F.col("block"), F.col("nth")], limit, rank="place")
    return articles.select("feed", *(["place"] if limit is not None else []), "block", "nth", "title", "url", "date", "excerpt", "image"), broken


def _articles(rows: DataFrame, excerpt: int | None) -> DataFrame:
    """Usable items with their date and excerpt."""
    date = r"(\d{1,2})\s+(\w{3})\s+(\d{4})"
    day, month, year = (F.regexp_extract("published", date, i) for i in (1, 2, 3))
    rows = rows.withColumn("date", F.when(F.col("published").rlike(date), F.concat_ws(
        "-", year, F.coalesce(look_up(MONTHS, month), F.lit("01")), F.lpad(day, 2, "0"))).otherwise(""))
    rows = rows.withColumn("excerpt", plain_excerpt(F.col("description"), excerpt))
    return rows.filter((F.col("title") != "") & (F.col("url") != ""))
