"""Small fixed tables as map expressions: no join, no shuffle, foldable by Catalyst."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(table: Mapping) -> Column:
    return F.create_map(*[F.lit(part) for pair in table.items() for part in pair])


def look_up(table: Mapping, key: Column) -> Column:
    """Value of ``key`` in a fixed table, null when it is absent."""
    return F.try_element_at(literal_map(table), key)
