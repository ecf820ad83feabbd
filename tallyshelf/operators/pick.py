"""Picking rows and order statistics per group, safe when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.session import settle


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column that is evaluated once per row.

    A plain projection may be copied into every later expression and filter that uses it; a
    one-element generator is not.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    Spark keeps one row per key inside every task before the shuffle, so a key with a third of all
    rows costs one row per task.
    """
    return top_per_group(df, keys, [F.struct(*order).desc()], 1)


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the least ``order`` per key; see ``latest_per_key``."""
    return top_per_group(df, keys, [F.struct(*order).asc()], 1)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                  rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group. Spark limits each group inside every task before the shuffle."""
    name = rank or "_rank"
    window = Window.partitionBy(*group).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def value_bin(value: Column, per_octave: int = 256) -> Column:
    """Monotone bin of a double: bins of equal relative width, mirrored for negative values."""
    scaled = F.log2(F.abs(value) * float(2**20) + 1.0) * per_octave
    return F.floor(F.signum(value) * scaled).cast("bigint")


def order_stats(df: DataFrame, group: Sequence[str], value: str,
                ranks: dict[str, Callable[[Column], Column]], count: str = "n") -> DataFrame:
    """Exact order statistics per group: one row per group with a column per entry of ``ranks``.

    ``ranks`` maps a name to a function from the group's row count to a zero-based rank. No group
    is ever sorted as a whole. Equal values collapse to (value, copies); values fall into narrow
    bins; running bin totals tell which bin holds each rank; only the rows of those bins are
    sorted, each bin apart. A group that holds a third of the rows is spread over its values.
    Null values and null groups are left out.
    """
    group = list(group)
    values = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # Read twice below, so the narrow counted values are kept instead of deriving them again.
    low = settle(values).withColumn("_bin", value_bin(F.col("_v")))
    in_group = Window.partitionBy(*group)
    bins = (
        low.groupBy(*group, "_bin").agg(F.sum("_c").alias("_size"))
        .withColumn("_before", F.coalesce(
            F.sum("_size").over(in_group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(count, F.sum("_size").over(in_group))
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (rank(F.col(count)) - F.col("_before")).cast("bigint").alias("rank"))
        for name, rank in ranks.items()
    ])
    hit_bins = (
        bins.withColumn("_wanted", F.filter(wanted, lambda w: (w["rank"] >= 0) & (w["rank"] < F.col("_size"))))
        .filter(F.size("_wanted") > 0)
        .select(*group, "_bin", count, "_wanted")
    )
    # The bin is part of the join key and of the window key: one shuffle serves both.
    in_bin = Window.partitionBy(*group, "_bin").orderBy("_v")
    hits = (
        low.join(hit_bins, [*group, "_bin"])
        .withColumn("_upto", F.sum("_c").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_hit", F.explode("_wanted"))
        .filter((F.col("_hit.rank") < F.col("_upto")) & (F.col("_hit.rank") >= F.col("_upto") - F.col("_c")))
    )
    return hits.groupBy(*group).agg(
        F.max(count).alias(count),
        *[F.max(F.when(F.col("_hit.name") == name, F.col("_v"))).alias(name) for name in ranks],
    )


def upper_median(n: Column) -> Column:
    """Rank of the element at ``n // 2`` of the sorted values."""
    return F.floor(n / 2)
