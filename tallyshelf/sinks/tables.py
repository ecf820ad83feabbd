"""Writing state, events and exports.

A table that is replaced whole gets a new version folder per write, one that batches are merged into hash
buckets (``buckets.py``). Small commit documents name what is finished; a write that dies half-way leaves a
folder no one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf import schemas
from tallyshelf.operators.diff import apply_snapshot
from tallyshelf.sinks.buckets import BucketTable
from tallyshelf.sinks.commits import Commits


class VersionedTable:
    """Parquet table that is replaced whole; its last few versions live side by side under one folder."""

    #: Batch ids that are remembered; a batch is tried again soon or never.
    BATCHES = 100

    def __init__(self, spark: SparkSession, path: str, schema=None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.commits = Commits(spark, f"{self.path}.log")

    def version(self) -> int | None:
        """Newest finished version, None for a table that was never written."""
        newest = self.commits.newest()
        return newest and newest["version"]

    def applied(self, batch: str) -> bool:
        """Whether a version was finished for this batch id."""
        return batch in (self.commits.newest() or {"batches": []})["batches"]

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/v={version}")

    def write(self, df: DataFrame, batch: str | None = None) -> int:
        """Write a new version, for a batch at most one: a batch that is tried again changes nothing."""
        newest = self.commits.newest() or {"version": 0, "batches": []}
        if batch is not None and batch in newest["batches"]:
            return newest["version"]
        version = newest["version"] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        batches = newest["batches"] + ([] if batch is None else [batch])
        dropped, _ = self.commits.add({"version": version, "batches": batches[-self.BATCHES:]})
        for old in dropped:
            self.commits.delete(f"{self.path}/v={old['version']}")
        return version


def append_events(events: DataFrame, path: str, batch: int | None = None) -> None:
    """Append to the event log, one folder per day so that time filters skip files.

    Rows are dealt by day first, so a write makes few files per day; Spark splits a day that is large.
    With a batch id a day has one folder per batch, and a batch that is tried again replaces its own.
    """
    dated = events.withColumn("event_date", F.to_date("ts")).hint("rebalance", "event_date")
    if batch is not None:
        dated.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "event_date", "batch").parquet(path)
        return
    dated.write.mode("append").partitionBy("event_date").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    fields = ["key", "type", "ts", "oos_hours", "event_date"]
    return spark.read.schema("key STRING, type STRING, ts TIMESTAMP, oos_hours DOUBLE, event_date DATE").parquet(path).select(*fields)


def take_snapshot(state: BucketTable, events_path: str, snapshot: DataFrame, now, min_oos_hours: float = 12,
                  batch: int | None = None) -> int:
    """Merge a snapshot into the state and log its events; returns the batch number.

    Only the buckets of the snapshot's keys are read, and only its keys written. Events go first: if the
    state write fails, the rerun finds the old state and raises the same events again. They lie under the
    batch's number, so they replace those of the first try.
    """
    batch = state.batch() + 1 if batch is None else batch
    if not state.applied(batch):
        new_state, events = apply_snapshot(state.read_for(snapshot), snapshot, now, min_oos_hours)
        append_events(events, events_path, batch)
        state.upsert(new_state, batch)
    return batch


def product_state(spark: SparkSession, path: str) -> BucketTable:
    return BucketTable(spark, path, schemas.PRODUCT_STATE)


def export_site(products: DataFrame, events: DataFrame, stats: DataFrame, path: str) -> None:
    """Products, events and figures as three JSON datasets."""
    for name, df in (("products", products), ("events", events), ("stats", stats)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def export_overlay(items: DataFrame, new_shops: DataFrame, path: str) -> None:
    """Published items and the shops not in the seed, as Parquet."""
    items.write.mode("overwrite").parquet(f"{path}/items")
    new_shops.write.mode("overwrite").parquet(f"{path}/shops")


def export_backup(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").json(path)


def replace_if_any(df: DataFrame, table: VersionedTable) -> bool:
    """Replace a small table unless the new rows are empty, so a failed fetch keeps the old ones."""
    if df.isEmpty():
        return False
    table.write(df)
    return True
