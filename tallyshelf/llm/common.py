"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.session import ensure_checkpoint_dir

#: ASCII white space and what is not, as Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: A side may be broadcast up to this many bytes; beyond it joins shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any spelling."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        base, n = name, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run, below the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def join_small(left: DataFrame, small: DataFrame, keys: list[str], how: str, row_bytes: int,
               limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a settled side that is broadcast when its counted rows fit ``limit`` bytes.

    Beyond the limit the join shuffles both sides, and Spark splits its skewed keys.
    """
    if small.count() * row_bytes <= limit:
        small = F.broadcast(small)
    return left.join(small, keys, how)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside the block hands Python tasks at most so many rows at a time; for rows that may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null counts 0."""
    kept = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(kept == "", F.lit(0)).otherwise(F.size(F.split(kept, SPACE + "+"))).cast("bigint")
