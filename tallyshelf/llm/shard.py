"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its own; the shards take turns,
a shard of weight w w times a round, to claim their next free slot. A document's key hash names its slot
and the slot its shard, so placing one costs a look-up, and when a shard comes or goes few slots change
hands. The table's size is a parameter, so what is broadcast does not grow with the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm.common import column, fresh

#: A prime well over 100 times the number of shards keeps shards within about 1 % of their share.
TABLE_SIZE = 65537


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """The table: for each slot the index of its shard. The order of ``shards`` decides only ties of turn."""
    if not _prime(size):
        raise ValueError(f"{size} is no prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be one to `size` different names")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of 1 or more per shard")
    # Walking start, start + step, ... modulo a prime visits every slot once: a permutation.
    place = [_number(f"{s}|start") % size for s in shards]
    step = [_number(f"{s}|step") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for k, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                while table[place[k]] >= 0:
                    place[k] = (place[k] + step[k]) % size
                table[place[k]] = k
                free -= 1
    return table


def slot(keys: Sequence[Column], size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of its hash modulo the table's size. Null parts have a mark of their own."""
    parts = [F.coalesce(F.concat(F.lit("+"), k.cast("string")), F.lit("-")) for k in keys]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: Sequence[str], keys: Sequence[str] = ("doc_id",), size: int = TABLE_SIZE,
          weights: Sequence[int] | None = None, into: str = "shard", slot_into: str | None = None) -> DataFrame:
    """Add the column ``into``, the name of each row's shard (and ``slot_into``, its slot).

    Equal keys, null keys and repeated rows go to the same shard each; an empty table gives none. A name
    that is taken already gives way: the new column gets a number. Texts are not read. Rows stay where
    they are: one broadcast of ``size`` short rows, no shuffle.
    """
    spark: SparkSession = docs.sparkSession
    rows = [(k, shards[s]) for k, s in enumerate(fill(shards, size, weights))]
    names = fresh(docs, slot_into or "_slot", into)
    table = spark.createDataFrame(rows, f"`{names[0]}` int, `{names[1]}` string")
    placed = docs.withColumn(names[0], slot([column(k) for k in keys], size)).join(F.broadcast(table), names[0])
    return placed.select(*[column(c) for c in docs.columns], *([column(names[0])] if slot_into else []), column(names[1]))


def write(docs: DataFrame, path: str, shards: Sequence[str], files_per_shard: int = 8, **options) -> None:
    """Write one folder per shard. A shard's rows are dealt over ``files_per_shard`` tasks at random of a
    hash, so a shard of any weight is no single task and a task writes to few folders."""
    placed = place(docs, shards, **options)
    name = [c for c in placed.columns if c not in docs.columns][-1]
    salt = F.pmod(F.xxhash64(*[column(c) for c in docs.columns if dict(docs.dtypes)[c] != "variant"]), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, column(name), salt).write.partitionBy(name).parquet(path)
