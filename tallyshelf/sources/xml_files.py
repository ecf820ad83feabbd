"""Feeds in XML read as files: an element is a record, so a large file is read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.text import unescape_html

#: Stands for the '&' of a reference that HTML knows and XML does not, until the element is parsed.
_HELD = "\ue000"
BROKEN = "_broken"


def read_elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Elements of a tag in a folder of files: (element, file, block, nth) and the folder's partition columns.

    A record ends at a closing tag, wherever the file is split; (block, nth) gives the order in the file. An
    element that is never closed reaches to the end of the next one; a closing tag inside a comment or CDATA
    section cuts its element. Both are then no XML, see ``parse_elements``. Empty elements (``<tag/>``) are left out.
    """
    rows = spark.read.text(path, lineSep=f"</{tag}>")
    opening = rf"<{tag}(?:\s[^>]*)?(?<!/)>"
    rows = rows.withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "nth": F.monotonically_increasing_id()})
    # Where a file breaks off, its last element is closed here and found to be broken later.
    rows = rows.filter(F.col("value").rlike(opening))
    return rows.withColumn("element", F.concat(F.regexp_extract("value", f"(?s)({opening}.*)$", 1), F.lit(f"</{tag}>"))).drop("value")


def parse_elements(elements: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(elements with their parsed form ``x``, elements that are no XML); ``schema`` is a DDL string.

    A string holds an element's last stretch of text, so markup inside it should be escaped or CDATA, as feeds have it;
    references that only HTML knows are still held back, see ``text_of``.
    """
    held = F.regexp_replace("element", r"&(?!(?:amp|lt|gt|quot|apos);)(?=[A-Za-z][A-Za-z0-9]*;)", _HELD)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "ignoreSurroundingSpaces": "false"}
    parsed = elements.withColumn("x", F.from_xml(held, f"{schema}, {BROKEN} string", options))
    fine = F.col("x").isNotNull() & F.col(f"x.{BROKEN}").isNull()
    return parsed.filter(fine), parsed.filter(~fine).drop("x")


def text_of(value: Column) -> Column:
    """A parsed string with the references of HTML decoded too; null is empty."""
    value = F.coalesce(value, F.lit(""))
    decoded = unescape_html(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit(_HELD), F.lit("&")))
    return F.when(value.contains(_HELD), decoded).otherwise(value)
