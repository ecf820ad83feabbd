import datetime as dt
from types import SimpleNamespace

import pandas as pd
import pytest

from tallyshelf.streaming import keyed_stream as K

HOUR = 3_600_000_000


@pytest.mark.parametrize("observations, want", [
    ([], []),
    ([(0, True)], [("new", 0, None)]),
    ([(0, False), (11 * HOUR, True)], []),
    ([(0, False), (12 * HOUR, True)], [("restock", 12 * HOUR, 12.0)]),
    # A short gap gives no event but moves the change time.
    ([(0, True), (HOUR, False), (2 * HOUR, True), (3 * HOUR, False), (15 * HOUR, True)],
     [("new", 0, None), ("soldout", HOUR, None), ("soldout", 3 * HOUR, None), ("restock", 15 * HOUR, 12.0)]),
    # Seen out of stock again and again, archived once, at its own time, before what comes after.
    ([(0, False), (20 * HOUR, False), (50 * HOUR, False), (60 * HOUR, True)], [("archive", 24 * HOUR, None), ("restock", 60 * HOUR, 60.0)]),
    ([(0, False), (24 * HOUR, True)], [("archive", 24 * HOUR, None), ("restock", 24 * HOUR, 24.0)]),
])
def test_fold(observations, want):
    for cut in range(len(observations) + 1):
        stock, events = K.fold(None, observations[:cut], 12, 24 * HOUR)
        assert events + K.fold(stock, observations[cut:], 12, 24 * HOUR)[1] == want


def test_out_of_order_ties_nulls_and_late_rows(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)
    schema = "key string, ts timestamp, available boolean, n int, type string"
    first = [("a", at(3), True, 1, "x"), ("a", at(1), True, 1, "x"), ("a", at(2), True, 1, "x"), ("a", at(2), False, 2, "x"), ("a", at(2), True, None, "x"),
             (None, at(1), True, 1, None), (None, at(2), False, 1, None), ("b", None, True, 1, "x"), ("b", at(5), None, 1, "x")]
    second = [("a", at(1, 5), False, 1, "x"), ("c", at(9), False, 1, "x"), (None, at(30), None, 1, "x"), ("c", at(9), False, 1, "x")]
    late = 0
    for rows in (first, second):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run = K.start_keyed(K.keyed_events(stream, "1 hour", order="n", archive_days=7), str(tmp_path / "out"), str(tmp_path / "cp"))
        run.awaitTermination()
        late += K.dropped_late(run)
    got = spark.read.schema(K.EVENTS).parquet(str(tmp_path / "out")).selectExpr("key", "type", "day(ts)", "oos_hours").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("a", "new", 1, None), ("a", "soldout", 2, None), ("a", "restock", 3, 24.0), (None, "new", 1, None), (None, "soldout", 2, None),
        (None, "archive", 9, None), ("c", "archive", 16, None)], key=str)
    assert late == 1
    assert spark.conf.get(K.PROVIDER, None) != K.ROCKSDB


class Held:
    """State of one key in memory, and the timers it asked for."""

    def __init__(self):
        self.cells, self.timers = {}, []

    def getValueState(self, name, schema):
        cells = self.cells

        class Value:
            get = staticmethod(lambda: cells.get(name))
            exists = staticmethod(lambda: name in cells)
            update = staticmethod(lambda value: cells.update({name: value}))
            clear = staticmethod(lambda: cells.pop(name, None))
        return Value

    def getMapState(self, name, key, value):
        held = self.cells.setdefault(name, {})

        class Map:
            keys = staticmethod(lambda: list(held))
            containsKey = staticmethod(held.__contains__)
            getValue = staticmethod(held.get)
            updateValue = staticmethod(held.__setitem__)
            removeKey = staticmethod(held.pop)
        return Map

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_one_timer_serves_all_slots_of_a_key():
    handle, day = Held(), 24 * HOUR
    keeper = K.StockKeeper(12, 60 * day, day)
    keeper.init(handle)
    frame = lambda *days: pd.DataFrame({"us": [d * day for d in days], "seq": 0, "available": [d % 2 == 0 for d in days]})
    at = lambda d: SimpleNamespace(getCurrentWatermarkInMs=lambda: d * day // 1000)
    fire = lambda d: [tuple(r) for f in keeper.handleExpiredTimer(("k",), at(d), SimpleNamespace(
        getExpiryTimeInMs=lambda: handle.timers[0])) for r in zip(f["type"], f["ts"].dt.day - 1)]
    list(keeper.handleInputRows(("k",), iter([frame(*range(3, 10)), frame(2)]), at(0)))
    assert handle.timers == [3 * day // 1000]
    list(keeper.handleInputRows(("k",), iter([frame(0), frame(1)]), at(0)))
    assert handle.timers == [3 * day // 1000, day // 1000]
    want = [("new", 0), *(("soldout" if d % 2 else "restock", d) for d in range(1, 10))]
    assert fire(6) == want[:6] and handle.timers[2:] == [7 * day // 1000, (5 + 60 + 1) * day // 1000]
    assert fire(6) == [] and fire(10) == want[6:]
    assert handle.cells["open"] == {} and "timer" not in handle.cells


def test_keys_of_a_bucket_share_entries_and_a_timer():
    handle, day = Held(), 24 * HOUR
    keeper = K.StockKeeper(12, 3 * day, day)
    keeper.init(handle)
    at = lambda d: SimpleNamespace(getCurrentWatermarkInMs=lambda: d * day // 1000)
    frame = lambda *rows: pd.DataFrame([(k, d * day, 0, a) for k, d, a in rows], columns=["key", "us", "seq", "available"])
    fire = lambda d: sorted((tuple(r) for f in keeper.handleExpiredTimer((7,), at(d), None)
                             for r in zip(f["key"], f["type"], f["ts"].dt.day - 1, f["oos_hours"].fillna(0))), key=str)
    list(keeper.handleInputRows((7,), iter([frame(("a", 0, True), ("b", 0, False), ("a", 1, False), (None, 1, True), ("c", 8, False))]), at(0)))
    list(keeper.handleInputRows((7,), iter([frame(("b", 2, True), ("a", 1, None), ("a", 0, True))]), at(0)))
    assert handle.timers == [day // 1000] and len(handle.cells["open"]) == 5
    assert fire(3) == sorted([("a", "new", 0, 0), ("a", "soldout", 1, 0), ("b", "restock", 2, 48), (None, "new", 1, 0)], key=str)
    assert handle.timers[1:] == [9 * day // 1000, 5 * day // 1000] and fire(3) == []
    keeper.init(handle)
    assert fire(5) == [("a", "archive", 4, 0)] and fire(9) == [] and handle.cells["open"] == {}
    assert [sorted(map(str, of)) for of in handle.cells["stock"]][0] == ["None", "a", "b", "c"]
