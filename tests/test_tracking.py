import datetime as dt
import random

from pyspark.sql import functions as F

from tallyshelf.operators import diff
from tallyshelf.operators import pages
from tallyshelf.sinks import tables
from tallyshelf.sinks.buckets import BucketTable
from tallyshelf.sinks.commits import KEPT, Commits
from tallyshelf.streaming import diff_stream

DAY0 = dt.datetime(2024, 1, 1)


def replay(rows, min_hours=12.0):
    """Plain replay of the truth table, one row at a time."""
    state, out = {}, []
    for key, ts, available in sorted(rows, key=lambda r: (r[1], r[0])):
        if key not in state:
            state[key] = [available, ts]
            if available:
                out.append((key, "new", ts, None))
            continue
        was, since = state[key]
        if available and not was:
            hours = (ts - since).total_seconds() / 3600
            if hours >= min_hours:
                out.append((key, "restock", ts, round(hours, 1)))
        elif was and not available:
            out.append((key, "soldout", ts, None))
        if available != was:
            state[key] = [available, ts]
    return sorted(out, key=str), state


def history(keys=30, steps=60, seed=3):
    rnd = random.Random(seed)
    rows = []
    for k in range(keys):
        # The first key has a third of all rows.
        n = steps * keys // 2 if k == 0 else steps
        seconds = sorted(rnd.sample(range(40 * 86400), n))
        rows += [(f"k{k}", DAY0 + dt.timedelta(seconds=s), rnd.random() < 0.6) for s in seconds]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp, available boolean")


def as_rows(df):
    return sorted((tuple(r) for r in df.select("key", "type", "ts", "oos_hours").collect()), key=str)


def test_slices_do_not_change_the_result(spark):
    rows = history()
    want, state = replay(rows)
    for days in (0.5, 7, 1000):
        assert as_rows(diff.snapshot_diff(frame(spark, rows), slice_days=days)) == want
    got = {r.key: (r.available, r.last_status_change) for r in diff.replay_state(frame(spark, rows), slice_days=2).collect()}
    assert got == {k: (a, ts) for k, (a, ts) in state.items()}


def test_gap_rule(spark):
    h = lambda x: DAY0 + dt.timedelta(hours=x)
    rows = [("a", h(0), False), ("a", h(12), True), ("b", h(0), False), ("b", h(11.99), True),
            ("c", h(0), True), ("c", h(1), False), ("c", h(6), True), ("c", h(7), False), ("c", h(18.5), True)]
    got = {(r[0], r[1]): r[3] for r in as_rows(diff.snapshot_diff(frame(spark, rows)))}
    assert got == {("a", "restock"): 12.0, ("c", "new"): None, ("c", "soldout"): None}


def test_last_copy_of_a_key_in_a_snapshot_counts(spark):
    rows = [("a", DAY0, True, 1), ("a", DAY0, False, 2), ("a", DAY0 + dt.timedelta(days=1), True, 1)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, available boolean, seq int")
    assert [r[1] for r in as_rows(diff.snapshot_diff(df, order="seq"))] == ["restock"]


def test_snapshot_by_snapshot_equals_replay(spark, tmp_path):
    times = [DAY0 + dt.timedelta(hours=9 * i) for i in range(5)]
    rnd = random.Random(5)
    rows = [(f"k{k}", t, rnd.random() < 0.5) for t in times for k in range(6) if rnd.random() < 0.8]
    schema = "key STRING, available BOOLEAN, first_seen TIMESTAMP, last_seen TIMESTAMP, last_status_change TIMESTAMP"
    state = BucketTable(spark, str(tmp_path / "state"), schema, buckets=4)
    for t in times:
        shot = frame(spark, [r for r in rows if r[1] == t]).drop("ts")
        tables.take_snapshot(state, str(tmp_path / "events"), shot, F.lit(t).cast("timestamp"))
    want, _ = replay(rows)
    assert as_rows(tables.read_events(spark, str(tmp_path / "events"))) == want
    assert state.batch() == len(times) - 1
    assert {r.key: (r.available, r.last_status_change) for r in state.read().collect()} == {
        k: tuple(v) for k, v in replay(rows)[1].items()}


def test_histories_in_pieces_equal_one_replay(spark):
    rows = sorted(history(keys=9, steps=24), key=lambda r: r[1])
    want, end = replay(rows)
    state = spark.createDataFrame([], "key STRING, available BOOLEAN, first_seen TIMESTAMP, last_seen TIMESTAMP, last_status_change TIMESTAMP")
    got, cuts = [], [0, 40, 41, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        state, events = diff.apply_history(state, frame(spark, rows[a:b]), slice_days=3)
        got += as_rows(events)
        state = spark.createDataFrame(state.collect(), state.schema)
    assert sorted(got, key=str) == want
    assert {r.key: (r.available, r.last_status_change) for r in state.collect()} == {k: tuple(v) for k, v in end.items()}
    firsts = {}
    for key, ts, _ in rows:
        firsts.setdefault(key, ts)
    assert {r.key: r.first_seen for r in state.collect()} == firsts


def test_late_snapshot_is_left_alone(spark):
    state = spark.createDataFrame([("a", True, DAY0, DAY0, DAY0)], "key string, available boolean, first_seen timestamp, "
                                  "last_seen timestamp, last_status_change timestamp")
    new, events = diff.apply_snapshot(state, spark.createDataFrame([("a", False)], "key string, available boolean"),
                                      F.lit(DAY0 - dt.timedelta(days=1)).cast("timestamp"))
    assert events.count() == 0 and new.first().available is True
    late = frame(spark, [("a", DAY0 - dt.timedelta(days=1), False)])
    new, events = diff.apply_history(state, late)
    assert events.count() == 0 and new.first().available is True


def test_stream_equals_batch(spark, tmp_path):
    rows = history(keys=8, steps=20)
    rows.sort(key=lambda r: r[1])
    third = len(rows) // 3
    for i in range(3):  # three files, read one per batch
        part = rows[i * third:] if i == 2 else rows[i * third:(i + 1) * third]
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
    source = spark.readStream.schema("key string, ts timestamp, available boolean, p int").option("maxFilesPerTrigger", 1).option(
        "latestFirst", False).parquet(str(tmp_path / "in"))
    run = diff_stream.snapshot_diff_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert as_rows(spark.read.parquet(str(tmp_path / "out"))) == replay(rows)[0]


def test_track_stream_into_state_table(spark, tmp_path):
    times = [DAY0 + dt.timedelta(hours=13 * i) for i in range(4)]
    rows = [("a", t, i % 2 == 0) for i, t in enumerate(times)] + [("b", times[1], True)]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "key STRING, available BOOLEAN, first_seen TIMESTAMP, last_seen TIMESTAMP, last_status_change TIMESTAMP"
    state = BucketTable(spark, str(tmp_path / "state"), schema, buckets=4)
    source = spark.readStream.schema("key string, ts timestamp, available boolean").parquet(str(tmp_path / "in"))
    diff_stream.track(source, state, str(tmp_path / "events"), str(tmp_path / "cp")).awaitTermination()
    assert as_rows(tables.read_events(spark, str(tmp_path / "events"))) == replay(rows)[0]


def test_bucket_table(spark, tmp_path):
    """Batches against a dictionary; buckets that a batch leaves alone keep their files; old folders go."""
    table = BucketTable(spark, str(tmp_path / "t"), "key STRING, v INT", buckets=5, deltas=2)
    assert table.read().count() == 0 and table.batch() == -1 and not table.applied(0)
    rnd, want = random.Random(9), {}
    for batch in range(12):
        rows = {f"k{rnd.randrange(40)}": rnd.randrange(1000) for _ in range(rnd.choice([1, 2, 15]))}
        frame_ = spark.createDataFrame(list(rows.items()), "key string, v int")
        before, touched = table.parts(), set(table.touched(frame_))
        assert table.upsert(frame_, batch) == batch and table.upsert(spark.createDataFrame([("k0", -1)], "key string, v int"), batch) == batch
        want |= rows
        after = table.parts()
        assert {k for k in after if after[k] != before.get(k)} == touched
        assert {r.key: r.v for r in table.read().collect()} == want
        assert all(len(of) <= 3 for of in after.values())
    some = spark.createDataFrame([("k1",), ("k7",), ("none",)], "key string")
    assert {r.key for r in table.read_for(some).collect()} == {"k1", "k7"} & set(want)
    on_disk = table.commits.glob(f"{table.path}/rows/bucket=*/part=*")
    assert len(on_disk) < 30 and len(table.commits.glob(f"{table.path}/log/c=*")) == KEPT
    wider = BucketTable(spark, table.path, "key STRING, v INT, extra STRING")
    wider.upsert(spark.createDataFrame([("k1", 5, "x")], "key string, v int, extra string"))
    assert {r.key: (r.v, r.extra) for r in wider.read().collect()} == {**{k: (v, None) for k, v in want.items()}, "k1": (5, "x")}
    # A write that died before its commit leaves a folder that no one reads and the next try replaces.
    spark.createDataFrame([("k2", 9, "lost", wider.batch() + 1)], "key string, v int, extra string, _batch bigint").write.parquet(
        f"{table.path}/rows/bucket=0/part=delta-{wider.batch() + 1}")
    assert wider.read().filter("extra = 'lost'").count() == 0
    wider.upsert(spark.createDataFrame([("k3", 1, "y")], "key string, v int, extra string"))
    assert wider.read().filter("extra = 'lost'").count() == 0 and wider.read().filter("extra = 'y'").count() == 1


def test_versions_and_commits(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "v"), "a INT")
    assert table.version() is None and table.read().count() == 0
    for k in range(6):
        assert table.write(spark.createDataFrame([(k,)], "a int"), f"b{k}") == k + 1
    assert table.write(spark.createDataFrame([(99,)], "a int"), "b5") == 6 and table.applied("b2") and not table.applied("b9")
    assert [r.a for r in table.read().collect()] == [5] and len(table.commits.glob(f"{table.path}/v=*")) == KEPT
    unfinished = Commits(spark, str(tmp_path / "c"))
    assert unfinished.newest() is None
    (tmp_path / "c" / "c=000000000001").mkdir(parents=True)
    assert unfinished.newest() is None


def test_pages(spark, tmp_path):
    rows = [(i % 7, f"r{i:03d}") for i in range(95)]
    df = spark.createDataFrame(rows, "k int, name string").repartition(5)
    order = [F.asc("k"), F.asc("name")]
    want = sorted(rows)
    assert sorted((r.nth, r.k, r.name) for r in pages.numbered(df, order, "nth").collect()) == [(i + 1, *r) for i, r in enumerate(want)]
    pages.write_pages(df, order, str(tmp_path / "p"), file_rows=20)
    listing = pages.Pages(spark, str(tmp_path / "p"), 9)
    assert listing.total == 95 and listing.last() == 10
    for number in (-3, 0, 1, 2, 9, 10, 11, 10_000):
        at = min(max(number, 0), 10) * 9
        page = listing.read(number)
        assert [tuple(r) for r in page.collect()] == want[at:at + 9] and len(page.inputFiles()) <= 2
    for key in range(-2, 9):
        behind = [r for r in want if r[0] > key]
        assert [tuple(r) for r in listing.read_after("k", key).collect()] == behind[:9], key
    down = [F.desc("k"), F.asc("name")]
    pages.write_pages(df, down, str(tmp_path / "d"), file_rows=20)
    for key in (8, 6, 3, 0):
        behind = sorted((r for r in rows if r[0] < key), key=lambda r: (-r[0], r[1]))
        assert [tuple(r) for r in pages.Pages(spark, str(tmp_path / "d"), 9).read_after("k", key, descending=True).collect()] == behind[:9]
    pages.write_pages(df.filter("false"), order, str(tmp_path / "e"))
    assert pages.Pages(spark, str(tmp_path / "e"), 9).read(3).count() == 0
