"""Snapshot differences on a stream, and the batch-by-batch form with a state table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tallyshelf.operators.diff import apply_history, late_rows
from tallyshelf.session import scratch, settle
from tallyshelf.sinks.buckets import BucketTable
from tallyshelf.sinks.tables import append_events

EVENT_SCHEMA = "key STRING, type STRING, ts TIMESTAMP, oos_hours DOUBLE"
_STATE_SCHEMA = "available BOOLEAN, changed_us LONG, seen_us LONG"


def _key_events(min_oos_hours: float):
    """State handler of one key: (available, change time, last seen) carried between batches."""

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable").drop_duplicates("us", keep="last")
        available, changed, seen = state.get if state.exists else (None, None, None)
        us, flags = rows["us"].to_numpy(), rows["available"].to_numpy(dtype=bool)
        if seen is not None:
            late = us < seen  # an older snapshot than the one already applied
            us, flags = us[~late], flags[~late]
        if len(us) == 0:
            return
        before = np.concatenate(([flags[0] if available is None else available], flags[:-1]))
        flips = np.flatnonzero(flags != before)
        out = []
        if available is None:
            changed = int(us[0])
            if flags[0]:
                out.append(("new", us[0], None))
        for i in flips:
            if flags[i]:
                hours = (int(us[i]) - changed) / 3.6e9
                if hours >= min_oos_hours:
                    out.append(("restock", us[i], round(hours, 1)))
            else:
                out.append(("soldout", us[i], None))
            changed = int(us[i])
        state.update((bool(flags[-1]), changed, int(us[-1])))
        if out:
            kinds, times, hours = zip(*out)
            yield pd.DataFrame({
                "key": key[0], "type": kinds, "ts": pd.to_datetime(list(times), unit="us"),
                "oos_hours": pd.Series(hours, dtype="float64"),
            })

    return handle


def snapshot_diff_stream(snapshots: DataFrame, key: str = "key", ts: str = "ts", available: str = "available",
                         min_oos_hours: float = 12, order: str | None = None) -> DataFrame:
    """Stream of events of a stream of snapshots; see ``operators.diff`` for the rules.

    State is three values per key, spread over the shuffle partitions by key. Rows older than the
    key's last applied snapshot are dropped.
    """
    rows = snapshots.select(
        F.col(key).cast("string").alias("key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(available).cast("boolean").alias("available"),
        (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("seq"),
    )
    return rows.groupBy("key").applyInPandasWithState(
        _key_events(min_oos_hours), EVENT_SCHEMA, _STATE_SCHEMA, "append", "NoTimeout"
    )


def merge_snapshots(state: BucketTable, rows: DataFrame, events_path: str, batch: int, *, late_path: str | None = None, ts: str = "ts",
                    min_oos_hours: float = 12, order: str | None = None) -> None:
    """Apply one batch of snapshots, any number of them, to the state table and the event log.

    The batch reads the buckets of its own keys and writes its own keys. A key that dominates it is spread over
    time slices. Rows older than what the state has seen of their key change nothing; with ``late_path`` they are
    kept there, by batch. A batch that is tried again replaces its own events and late rows.
    """
    if state.applied(batch):
        return
    with scratch(state.spark):
        rows = settle(rows)
        known = settle(state.read_for(rows))
        new_state, events = apply_history(known, rows, ts, min_oos_hours, order)
        if late_path:
            late_rows(known, rows, ts).write.mode("overwrite").parquet(f"{late_path}/batch={batch}")
        append_events(events, events_path, batch)
        state.upsert(new_state, batch)


def track(snapshots: DataFrame, state: BucketTable, events_path: str, checkpoint: str, *, trigger: dict | None = None, **options):
    """Run a stream of snapshots into the state table and the event log, batch by batch; see ``merge_snapshots``."""
    writer = snapshots.writeStream.foreachBatch(lambda batch, number: merge_snapshots(state, batch, events_path, number, **options))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
