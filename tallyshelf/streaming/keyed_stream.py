"""Stock events on a stream in the order of event time, out of state kept per bucket of keys on disk.

Observations wait in time slots. A slot is folded once the watermark has passed its end, so snapshots may
come out of order by the watermark's delay, over any number of batches, and a task holds one slot of one bucket.
What is out of stock for long enough is archived by a timer, whether or not its key is seen again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "key STRING, type STRING, ts TIMESTAMP, oos_hours DOUBLE"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


def fold(stock: tuple | None, observations: list[tuple[int, bool]], min_oos_hours: float, archive_us: int) -> tuple[tuple | None, list[tuple]]:
    """Stock (available, change time, archived) after observations in time order, and (type, time, hours) of their events."""
    events = []
    for us, available in observations:
        if stock is None:
            if available:
                events.append(("new", us, None))
            stock = (available, us, False)
            continue
        stock, archived = archive(stock, us, archive_us)
        events += archived
        was, changed, _ = stock
        if was == available:
            continue
        if not available:
            events.append(("soldout", us, None))
        elif (hours := (us - changed) / 3.6e9) >= min_oos_hours:
            events.append(("restock", us, round(hours, 1)))
        stock = (available, us, False)
    return stock, events


def archive(stock: tuple, now_us: int, archive_us: int) -> tuple[tuple, list[tuple]]:
    """The stock at a time, archived once if it has been out for that long."""
    available, changed, archived = stock
    if available or archived or changed + archive_us > now_us:
        return stock, []
    return (available, changed, True), [("archive", changed + archive_us, None)]


class StockKeeper(StatefulProcessor):
    """State of a bucket of keys: the stock of each key, the observations of open slots, and the timer of the earliest of them.

    A bucket has one timer for all its open slots: when it fires, every slot whose end has passed is folded, one after
    another, and the earliest that stays open is waited for. What a batch brings of a slot is kept as one entry and
    not touched again before the slot is folded. Rows without a column ``key`` are all of the key grouped by.
    """

    #: Events that are passed on at once.
    EVENTS = 10_000

    def __init__(self, min_oos_hours: float, archive_us: int, slot_us: int):
        self.min_oos_hours, self.archive_us, self.slot_us = min_oos_hours, archive_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stock = handle.getValueState("stock", "key ARRAY<STRING>, available ARRAY<BOOLEAN>, changed ARRAY<BIGINT>, archived ARRAY<BOOLEAN>")
        self.open = handle.getMapState("open", "slot BIGINT, entry BIGINT",
                                       "key ARRAY<STRING>, us ARRAY<BIGINT>, seq ARRAY<BIGINT>, available ARRAY<BOOLEAN>")
        self.timer = handle.getValueState("timer", "ms BIGINT, entry BIGINT")
        self.folded = None

    def _end_ms(self, slot: int) -> int:
        return -(-(slot + 1) * self.slot_us // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, self.folded = self.timer.get(), None
        waits, entry = timer or (None, 0)
        for frame in rows:
            frame = frame[frame["available"].notna()]
            if "key" not in frame:
                frame = frame.assign(key=key[0])
            for slot, part in frame.groupby(frame["us"] // self.slot_us):
                slot, entry = int(slot), entry + 1
                self.open.updateValue((slot, entry), tuple(part[c].tolist() for c in ("key", "us", "seq", "available")))
                if waits is None or self._end_ms(slot) < waits:
                    waits = self._end_ms(slot)
        if waits is not None:
            if timer is None or waits < timer[0]:
                self.handle.registerTimer(waits)
            self.timer.update((waits, entry))
        yield from ()

    def _frame(self, events: list[tuple]) -> pd.DataFrame:
        keys, kinds, times, hours = zip(*events)
        return pd.DataFrame({"key": pd.Series(keys, dtype="object"), "type": kinds, "ts": pd.to_datetime(list(times), unit="us"),
                             "oos_hours": pd.Series(hours, dtype="float64")})

    def _seen(self, entries: list[tuple]) -> dict:
        """Observations of entries by key, in time order; of one time the last by seq, then as they came."""
        seen = {}
        for held in map(self.open.getValue, entries):
            for name, *observation in zip(*held):
                seen.setdefault(name, []).append(observation)
        return {name: list({us: available for us, _, available in sorted(of, key=lambda o: o[:2])}.items()) for name, of in seen.items()}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        if self.folded == (key, now_ms):  # several timers of a bucket came due at once
            return
        self.folded = key, now_ms
        before = {name: tuple(of) for name, *of in zip(*(self.stock.get() or ()))}
        stocks, slots, events = dict(before), {}, []
        for slot, entry in sorted(map(tuple, self.open.keys())):
            slots.setdefault(slot, []).append((slot, entry))
        ended = [s for s in slots if self._end_ms(s) <= now_ms]
        for slot in ended:
            for name, seen in self._seen(slots[slot]).items():
                stocks[name], more = fold(stocks.get(name), seen, self.min_oos_hours, self.archive_us)
                events += [(name, *event) for event in more]
                if len(events) >= self.EVENTS:
                    yield self._frame(events)
                    events = []
            for entry in slots[slot]:
                self.open.removeKey(entry)
        if ended and len(ended) == len(slots):
            self.timer.clear()
        elif ended:
            first = next(s for s in slots if self._end_ms(s) > now_ms)
            self.handle.registerTimer(self._end_ms(first))
            self.timer.update((self._end_ms(first), self.timer.get()[1]))
        # Known is all before the last slot boundary: no slot that is open yet begins before it.
        closed, later = now_ms * 1000 // self.slot_us * self.slot_us, set()
        for name, stock in stocks.items():
            if not stock[0] and not stock[2]:
                due = stock[1] + self.archive_us
                if due < closed:
                    stocks[name], archived = archive(stock, due, self.archive_us)
                    events += [(name, *event) for event in archived]
                elif stock != before.get(name):
                    later.add(self._end_ms(due // self.slot_us))
        for ms in sorted(later):
            self.handle.registerTimer(ms)
        if stocks != before:
            self.stock.update(tuple(map(list, zip(*((name, *stock) for name, stock in stocks.items())))))
        if events:
            yield self._frame(events)

    def close(self) -> None:
        pass


def keyed_events(snapshots: DataFrame, delay: str = "1 day", *, key: str = "key", ts: str = "ts", available: str = "available",
                 order: str | None = None, min_oos_hours: float = 12, archive_days: float = 14, slot_hours: float = 6,
                 buckets: int = 1024) -> DataFrame:
    """Stream of new, restock, soldout and archive events of a stream of snapshots.

    Of a key's rows of one time the last by ``order`` counts. A row without ``available`` is no observation
    but moves time on, a null key is a key, rows without a time are left out. Rows older than the watermark
    (newest time less ``delay``) are dropped and counted, see ``dropped_late``. Events come when their slot is
    closed, ``archive`` when ``archive_days`` have passed since the change and no later change is known.
    Keys share their state with those of the same hash bucket; the number of buckets stays that of the checkpoint.
    A task holds one slot and the stock of one bucket, so let there be more buckets for many millions of keys.
    """
    rows = snapshots.select(
        F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"),
        F.col(available).cast("boolean").alias("available"),
        (F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63))) if order else F.lit(0).cast("long")).alias("seq"))
    rows = rows.filter(F.col("ts").isNotNull()).withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    keeper = StockKeeper(min_oos_hours, round(archive_days * DAY_US), round(slot_hours * DAY_US / 24))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(keeper, EVENTS, "Append", "EventTime")


def start_keyed(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the events to a table of files, with RocksDB as the state store of this one query."""
    conf = events.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def dropped_late(run: StreamingQuery) -> int:
    """Rows that a run dropped as older than the watermark."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in run.recentProgress for operator in progress["stateOperators"])
