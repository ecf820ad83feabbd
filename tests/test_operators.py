import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import billing, digest, neighbours, pick, preference, profile, userlog
from tallyshelf.operators.pick import order_stats, upper_median
from tallyshelf.streaming import alerts, billing_stream
from workload import runs


def test_order_stats_with_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.choice([5.0, 7.25, rnd.uniform(-3, 3), rnd.uniform(0, 1e6)])) for _ in range(3000)]
    rows += [(f"g{i % 40}", rnd.uniform(-50, 50)) for i in range(1500)] + [("one", 4.0), ("hot", None)]
    ranks = {"lo": lambda n: F.floor(n / 10), "hi": lambda n: n - 1 - F.floor(n / 10), "mid": upper_median}
    got = {r.g: (r.n, r.lo, r.hi, r.mid) for r in order_stats(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ranks).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    for g, vs in groups.items():
        vs.sort()
        n = len(vs)
        assert got[g] == (n, vs[n // 10], vs[n - 1 - n // 10], vs[n // 2])
    assert set(got) == set(groups)


def test_pick_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "n"), ("b", 0, "m")], "k string, o int, v string")
    assert {r.k: r.v for r in pick.latest_per_key(df, ["k"], [F.col("o")]).collect()} == {"a": "y", "b": "m"}
    assert {r.k: r.v for r in pick.earliest_per_key(df.na.drop(), ["k"], [F.col("o")]).collect()} == {"a": "x", "b": "m"}


def brute_nearest(items, same):
    def distance(a, b):
        gap = min(30.0, abs(math.log2(b[6] / a[6])) * 8) if a[6] >= 1 and b[6] >= 1 else 0.0
        return math.hypot(a[4] - b[4], a[5] - b[5]) + (0 if a[3] == b[3] else 18) + gap + (12 if a[2] == b[2] else 0)

    out = {}
    for a in items:
        if same and a[1] in ("", "ブレンド"):
            continue
        pool = [b for b in items if b[0] != a[0] and b[1] not in ("", "ブレンド") and (b[1] == a[1]) == same]
        if pool:
            d, match = min((distance(a, b), b[0]) for b in pool)
            out[a[0]] = (match, round(d, 6))
    return out


def test_nearest_item_against_brute_force(spark):
    rnd = random.Random(11)
    items = []
    for i in range(260):
        if i % 3 == 0:  # a third of all items on one point, with few prices and shops
            x, y, price, shop = 50.0, 50.0, rnd.choice([1000.0, 2000.0]), rnd.choice(["s0", "s1"])
        else:
            x, y, price, shop = rnd.uniform(4, 96), rnd.uniform(4, 96), rnd.choice([0.0, rnd.uniform(200, 90000)]), f"s{rnd.randint(0, 9)}"
        items.append((i, rnd.choice(["A", "A", "A", "B", "ブレンド", "", "C"]), shop, rnd.choice(["berry", "citrus", "choco"]), x, y, price))
    df = spark.createDataFrame(items, "id int, origin string, shop string, family string, x double, y double, p100 double")
    for same, levels in ((True, 3), (False, 3), (True, None), (False, None)):
        got = neighbours.nearest_item(df, df, same_origin=same, levels=levels).collect()
        assert {r.id: (r.match, round(r.distance, 6)) for r in got} == brute_nearest(items, same)
    both = {r.id: (r.same_origin, r.similar) for r in neighbours.next_items(df, df).collect()}
    assert len(both) == len(items) and both[items[1][0]][1] == brute_nearest(items, False)[items[1][0]][0]


def test_digest_wording(spark):
    events = [("new", "Ethiopia Washed", "A", None, 1), ("new", "Panama Geisha", "B", None, 2), ("new", "Sidra Anaerobic", "C", None, 3),
              ("new", "Cup of Excellence #12", "D", None, 4), ("new", "House Blend", "E", None, 5), ("soldout", "Kenya", "F", None, 6),
              ("restock", "Ethiopia Guji", "G", 72.0, 7)]
    df = spark.createDataFrame(events, "type string, title string, shop string, oos_hours double, pos int")
    order = [F.col("pos")]
    both = digest.push_message(df, order).first()
    assert (both.title, both.body, both.url) == ("再入荷 1件・新着レアロット 3件", "Panama Geisha — B ほか", "?v=geisha")
    one = digest.push_message(df.filter("type = 'restock'"), order).first()
    assert one.body == "Ethiopia Guji — G（約3日ぶり）" and one.url == "?v=zukan"
    rare = digest.push_message(df.filter("pos = 2"), order).first()
    assert (rare.title, rare.tag) == ("レアロットが入りました", "rare")
    assert digest.push_message(df.filter("type = 'soldout'"), order).count() == 0


def test_merge_keeps_columns_the_incoming_rows_lack(spark):
    current = spark.createDataFrame([(1, 10, "old", "keep"), (2, 10, "mine", "k2")], "id int, at long, v string, own string")
    incoming = spark.createDataFrame([(1, 10, "new"), (2, 9, "late"), (3, None, "fresh"), (None, 1, "x")], "id int, at long, v string")
    got = {r.id: (r.v, r.own) for r in userlog.merge_lww(current, incoming, ["id"]).collect()}
    assert got == {1: ("new", "keep"), 2: ("mine", "k2"), 3: ("fresh", None)}


def test_adopting_anonymous_rows(spark):
    log = spark.createDataFrame([("u1", 1)], "user string, item_id int")
    anonymous = spark.createDataFrame([("d1", 7), ("d2", 8)], "device string, item_id int")
    logins = spark.createDataFrame([("d1", "u1"), ("d2", "u2")], "device string, user string")
    assert sorted((r.user, r.item_id) for r in userlog.adopt_anonymous(log, anonymous, logins).collect()) == [("u1", 1), ("u2", 8)]


def test_learning_in_pieces(spark):
    rnd = random.Random(2)
    rows = [("u", "f", rnd.choice([-8.0, -1.0, 2.0, 9.0]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i)) for i in range(400)]
    level = 0.0
    for r in rows:
        level = max(-4.0, min(4.0, level + 0.5 * r[2]))
    df = spark.createDataFrame(rows, "user string, feature string, weight double, ts timestamp")
    for chunk, hours in ((3, 5), (1000, 24)):
        assert abs(preference.learn(df, chunk=chunk, slice_hours=hours).first().weight - level) < 1e-9


def test_scores_do_not_depend_on_the_packing(spark):
    rnd = random.Random(4)
    profiles = spark.createDataFrame([(f"s{i}", f, rnd.gauss(0, 1)) for i in range(37) for f in ("light", "clean", "asia")],
                                     "shop string, feature string, z double")
    weights = spark.createDataFrame([(f"u{i}", f, rnd.gauss(0, 1)) for i in range(9) for f in ("light", "clean")],
                                    "user string, feature string, weight double")
    liked = spark.createDataFrame([("u1", "s3", 5.0), ("u77", "s4", 2.0)], "user string, shop string, weight double")
    def run(**kw):
        rows = preference.score_shops(weights, profiles, liked, n=4, **kw).collect()
        return sorted((r.user, r.place, r.shop, round(r.score, 9)) for r in rows)
    assert run(per_block=3, per_slab=10, per_share=7) == run(per_block=1000) == run(per_block=1)
    assert [r[2] for r in run() if r[0] == "u77"][0] == "s4"


def test_products_in_single_precision_settle_no_place(spark, monkeypatch):
    features = ("light", "clean", "asia")
    # Shops alike but for the tenth digit, and equal ones, which go by name.
    z = {f"s{i:04}": [1 + (i % 7) * 1e-10, 0.3, (i % 3) * 1e-11] for i in range(300)}
    weight = {"u1": [1.0, 0.5, 0.0], "u2": [0.0, 0.0, -1.0], "u3": [1e30, 0.0, 1e30], "u4": [0.0, 0.0, 0.0], "u5": [1e300, 0.0, 0.0]}
    tall = lambda rows: [(k, f, v) for k, values in rows.items() for f, v in zip(features, values)]
    profiles = spark.createDataFrame(tall(z), "shop string, feature string, z double")
    weights = spark.createDataFrame(tall(weight), "user string, feature string, weight double")
    score = lambda u, s: sum((a * b for a, b in zip(weight[u], z[s])), 0.0)
    want = {u: sorted(z, key=lambda s: (-score(u, s), s))[:5] for u in weight}
    for kw in ({}, {"per_block": 7, "per_slab": 90}):
        rows = preference.score_shops(weights, profiles, n=5, features=features, **kw).orderBy("user", "place").collect()
        assert {u: [r.shop for r in rows if r.user == u] for u in want} == want
        assert all(r.score == score(r.user, r.shop) for r in rows)
    # A tile's whole sums are not made again: only shops that the product leaves open are.
    seen = []
    first_of = preference._first_of
    monkeypatch.setattr(preference, "_first_of", lambda rows, *a: (seen.append(len(rows)), first_of(rows, *a))[1])
    rnd = np.random.default_rng(3)
    schema = pa.schema([("user", pa.int64()), ("shop", pa.string()), ("score", pa.float64()), ("visited", pa.int64()), ("blocks", pa.int64())])
    blocks = pa.table({"_shops": [[f"b{b}s{i}" for i in range(64)] for b in range(40)], "_z": rnd.normal(size=(40, 64 * 3)).tolist()})
    users = pa.table({"user": list(range(100)), "weight": rnd.normal(size=(100, 3)).tolist()})
    assert preference._best_of_slab(5, 3, schema)(users, blocks).num_rows == 500
    assert sum(seen) < 100 * 40 * 64 / 20


def test_a_tally_reads_its_items_once(spark):
    rows = [("s1", "JPY", "ケニア", "Washed", "geisha", 300.0, 3), ("s1", "USD", "ケニア", "Anaerobic Natural", None, 500.0, 1),
            ("s1", "USD", None, None, None, None, 2), ("s2", None, "", "Honey", "sidra", 400.0, None), (None, "JPY", "ブラジル", "", None, 200.0, 7)]
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    schema = "shop string, cur string, origin string, process string, variety string, p100 double, seq bigint"
    items = spark.createDataFrame(rows, schema).mapInArrow(passed, schema)
    got = {r.shop: (r.n, r.n_origin, r.africa, r.latam, r.asia, r.clean, r.natural, r.experimental, r.geisha, r.cur, r.price)
           for r in profile.shop_tally(items, "seq").collect()}
    assert got == {"s1": (3, 2, 2, 0, 0, 1, 0, 1, 1, "USD", 500.0), "s2": (1, 0, 0, 0, 0, 0, 1, 0, 1, None, 400.0),
                   None: (1, 1, 0, 1, 0, 0, 0, 0, 0, "JPY", 0.0)}
    assert read.value == len(rows)


def test_entries_of_a_rating_are_not_filtered_by_a_lambda(spark):
    ratings = spark.createDataFrame([("u", 1, "s1", None, 5), ("u", 2, "s1", "ケニア", 1)], "user string, item_id int, shop string, origin string, rating int")
    items = spark.createDataFrame([(1, "ブラジル", "Natural", None), (2, None, "Washed", "geisha")], "id int, origin string, process string, variety string")
    shops = spark.createDataFrame([("s1", "JP", "eastAsia")], "shop string, country string, region string")
    taste = preference.taste_features(ratings, items, shops)
    got = {(r.kind, r.name): (round(r.weight, 9), r.n) for r in taste.collect()}
    assert got == {("attr", "latam"): (2.4, 1), ("attr", "africa"): (-1.44, 1), ("attr", "natural"): (2.0, 1), ("attr", "clean"): (-0.96, 1),
                   ("attr", "geisha"): (-1.2, 1), ("attr", "domestic"): (0.48, 2), ("attr", "asia"): (0.4, 2), ("affinity", "s1"): (1.6, 1),
                   ("group", "latam"): (1.0, 1), ("process", "Natural/Honey"): (1.0, 1)}
    assert "lambdafunction" not in taste._jdf.queryExecution().optimizedPlan().toString()


BILLING = ("event_id string, type string, ts timestamp, user_id string, customer_id string, subscription_id string, status string, "
           "price_id string, interval string, current_period_end timestamp")


def billing_rows():
    day = lambda d: dt.datetime(2024, 1, d)
    return [
        ("e1", billing.CHECKOUT, day(1), "u1", "c1", "s1", "active", "p", "year", day(20)),
        ("e1", billing.CHECKOUT, day(2), "u1", "c1", "s1", "past_due", "p", "month", day(21)),  # delivered again
        ("e2", billing.CHECKOUT, day(1), None, "c2", "s2", "active", None, "month", day(20)),  # nobody to give it to
        ("e3", billing.CHECKOUT, day(3), "u3", "c3", None, None, None, None, None),  # one-off payment
        ("e4", billing.PAID, day(5), None, "c1", "s1", "active", None, "year", day(28)),
        ("e5", billing.UPDATED, day(6), None, "c9", "s9", "active", None, "year", day(28)),  # unknown customer
        ("e6", billing.DELETED, day(7), None, "c3", "s3", "active", None, "month", day(9)),
    ]


def check_entitlements(rows):
    by = {r.user_id: r for r in rows}
    assert set(by) == {"u1", "u3"}
    assert (by["u1"].plan, by["u1"].status, by["u1"].current_period_end.day, by["u1"].subscription_id) == ("premium_yearly", "active", 28, "s1")
    assert (by["u3"].plan, by["u3"].status, by["u3"].customer_id, by["u3"].subscription_id) == ("free", "canceled", "c3", "s3")


def test_entitlements(spark):
    check_entitlements(billing.fold_entitlements(spark.createDataFrame(billing_rows(), BILLING)).collect())


def test_customer_follows_the_latest_checkout(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    def event(i, kind, d, user, customer, status):
        return (f"e{i}", kind, day(d), user, customer, f"s{i}", status, None, "month", day(d))
    rows = [event(i, billing.CHECKOUT, d, "u", c, "active") for i, (d, c) in enumerate([(1, "a"), (2, "a"), (9, "a"), (12, "b"), (20, "a")])]
    rows += [event(i, billing.PAID, d, None, c, "x") for i, (d, c) in enumerate([(3, "a"), (13, "a"), (14, "b"), (21, "b"), (22, "a")], 10)]
    found = billing.with_user(spark.createDataFrame(rows, BILLING)).filter(F.col("type") == billing.PAID)
    assert sorted(r.event_id for r in found.collect()) == ["e10", "e12", "e14"]


def test_entitlement_stream_equals_batch(spark, tmp_path):
    rows = billing_rows()
    for i, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, BILLING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
    source = spark.readStream.schema(BILLING + ", p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("p")
    table = billing_stream.Entitlements(spark, str(tmp_path / "ent"), buckets=3)
    billing_stream.maintain_entitlements(source, table, str(tmp_path / "cp")).awaitTermination()
    check_entitlements(table.read().collect())
    # A batch that is tried again changes nothing.
    before = sorted(map(str, table.read().collect()))
    table.merge(spark.createDataFrame(rows, BILLING), 0)
    assert sorted(map(str, table.read().collect())) == before and table.users.batch() == 2


def test_entitlement_batches_out_of_order_equal_one_fold(spark, tmp_path):
    """Batches that mix times, repeat events and bring checkouts after the events they own; customers change users."""
    rnd = random.Random(12)
    kinds = [billing.CHECKOUT, billing.PAID, billing.UPDATED, billing.DELETED]
    rows = []
    for k in range(160):
        kind = rnd.choice(kinds)
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(500))
        user = rnd.choice([f"u{rnd.randrange(6)}"] * 5 + [None]) if kind == billing.CHECKOUT else None
        customer = rnd.choice([f"c{rnd.randrange(5)}"] * 6 + [None])
        rows.append((f"e{k}", kind, at, user, customer, rnd.choice(["s1", "s2", None]), rnd.choice(["active", "past_due", None]), None,
                     rnd.choice(["month", "year"]), rnd.choice([at, None])))
    want = sorted(map(str, billing.fold_entitlements(spark.createDataFrame(rows, BILLING)).select(
        "user_id", *billing.FIELDS, "updated_at").collect()))
    rnd.shuffle(rows)
    table = billing_stream.Entitlements(spark, str(tmp_path / "ent"), buckets=4)
    sent = []
    for number, part in enumerate((rows[:60], rows[60:110], rows[110:])):
        sent += part
        table.merge(spark.createDataFrame(part + rnd.sample(sent, 15), BILLING), number)
    assert sorted(map(str, table.read().collect())) == want


def test_one_message_per_batch(spark, tmp_path):
    ddl = "key string, type string, ts timestamp, oos_hours double"
    rows = [("k1", "restock", dt.datetime(2024, 1, 2), 30.0), ("k2", "soldout", dt.datetime(2024, 1, 2), None)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    products = spark.createDataFrame([("k1", "Kenya AA", "S"), ("k2", "Peru", "S")], "key string, title string, shop string")
    source = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    alerts.digest_per_batch(source, products, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.body, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("Kenya AA — S（約1日ぶり）", 0)]


def test_alerts_once_per_user(spark):
    events = spark.createDataFrame([("k", "restock", 1), ("k", "restock", 1), ("k", "new", 2), ("x", "restock", 3)], "key string, type string, ts int")
    watches = spark.createDataFrame([("u1", "k"), ("u2", "k")], "user string, key string")
    assert sorted(r.user for r in alerts.restock_alerts(events, watches).collect()) == ["u1", "u2"]


def test_alerts_are_made_once_and_not_gathered(spark):
    """Repeated events and watches give one alert each, without a grouping of the alerts themselves."""
    events = spark.createDataFrame([("k", "restock", 1)] * 2 + [("k", "restock", 2), (None, "restock", 2)], "key string, type string, ts int")
    watches = spark.createDataFrame([("u1", "k")] * 2 + [(None, "k")] * 2 + [("u2", None)], "user string, key string")
    hits = alerts.restock_alerts(events, watches)
    assert sorted((r.user or "", r.ts) for r in hits.collect()) == [("", 1), ("", 2), ("u1", 1), ("u1", 2)]
    plan = hits._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Join" in next(line for line in plan if "Join" in line or "Aggregate" in line)


def test_watches_of_many_users_are_not_dealt_anew(spark, tmp_path, monkeypatch):
    """Where all users are too many for a broadcast, they come in blocks; the watches still lie by key and are never shuffled."""
    monkeypatch.setattr(runs, "_USERS", 300, raising=False)
    ts, sf = dt.datetime(2024, 1, 1), str(tmp_path)
    stock = [(k, ts + dt.timedelta(days=d), e) for k in [3, 28, 29, None] for d, e in enumerate(("view", "error", "view"))] + [(40, ts, "view")]
    spark.createDataFrame(stock, "user_id bigint, ts timestamp_ntz, event_type string").write.parquet(f"{sf}/events.parquet")
    users = [(c, c % 26 if c % 26 < 25 else None) for c in range(2000)] + [(3, 3), (55, 3)]
    spark.createDataFrame(users, "c_custkey bigint, c_nationkey int").write.parquet(f"{sf}/customer.parquet")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, 5000)
    try:
        hits = runs.restock_alerts(spark, sf)
        assert "hashpartitioning(user" not in hits._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, hits.collect()))
    finally:
        spark.conf.set(limit, before)
    assert got == sorted({(k, ts + dt.timedelta(days=2), c) for k in (3, 28, 29) for c, n in users if n == k % 25})


def test_alerts_on_a_stream(spark, tmp_path):
    """A restock that is delivered in two batches alerts each watcher once."""
    ddl = "key string, type string, ts timestamp"
    rows = [("k", "restock", dt.datetime(2024, 1, 2)), ("k", "new", dt.datetime(2024, 1, 2)), ("x", "restock", dt.datetime(2024, 1, 2))]
    for i, part in enumerate((rows, rows[:1] + [("k", "restock", dt.datetime(2024, 1, 3))])):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    source = spark.readStream.schema(ddl + ", p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watches = spark.createDataFrame([("u1", "k"), ("u2", "k")], "user string, key string")
    run = alerts.restock_alerts(source, watches).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("user", F.dayofmonth("ts")).collect()
    assert sorted(map(tuple, got)) == [("u1", 2), ("u1", 3), ("u2", 2), ("u2", 3)]


def test_alerts_while_watches_change(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    box = alerts.RestockAlerts(spark, str(tmp_path / "a"), buckets=2)
    r = lambda *days: spark.createDataFrame([("k", at(d)) for d in days], "key string, ts timestamp")
    t = lambda *rows: spark.createDataFrame([(u, "k", at(d)) for u, d in rows], "user string, key string, at timestamp")
    sent = lambda: sorted((x.user, x.ts.day) for x in box.read().collect())
    box.merge(0, r(5), t(("u", 1), ("v", 6)))
    assert sent() == [("u", 5)]
    box.merge(1, r(5, 7), t(("u", 6), ("u", 1)))  # u goes off before 7, v is on since 6
    assert sent() == [("u", 5), ("v", 7)]
    for _ in range(2):
        box.merge(2, r(), t(("w", 2)))  # late, and tried again
        assert sent() == [("u", 5), ("v", 7), ("w", 5), ("w", 7)]


def test_alerts_look_up_returning_watchers_alone(spark, tmp_path):
    """What was sent is read for watches that were toggled before; a first toggle, however late, reads none of it."""
    at = lambda d: dt.datetime(2024, 1, d)
    box = alerts.RestockAlerts(spark, str(tmp_path / "a"), buckets=2)
    r = lambda *days: spark.createDataFrame([("k", at(d)) for d in days], "key string, ts timestamp")
    t = lambda *rows: spark.createDataFrame([(u, "k", at(d)) for u, d in rows], "user string, key string, at timestamp")
    asked, read = [], box.sent.read
    box.sent.read = lambda names, before: asked.append(names.count()) or read(names, before)
    box.merge(0, r(5, 7), t(("u", 1), ("u", 6)))
    box.merge(1, r(), t(("w", 2)))
    assert asked == [0, 0] and sorted((x.user, x.ts.day) for x in box.read().collect()) == [("u", 5), ("w", 5), ("w", 7)]
    want = [("u", 5), ("u", 7), ("w", 5), ("w", 7)]
    for number, day in ((2, 4), (3, 3)):  # u is off at 5 and on at 7, then the other way round; what was sent stays
        box.merge(number, r(), t(("u", day)))
        assert sorted((x.user, x.ts.day) for x in box.read().collect()) == want
    assert asked[2:] == [1, 1]


def test_alerts_in_slices_of_keys(spark, tmp_path, monkeypatch):
    """A batch that is worked on in slices sends each alert once, also where it replaces an attempt that was cut off."""
    at = lambda d: dt.datetime(2024, 1, d)
    box, keys = alerts.RestockAlerts(spark, str(tmp_path / "a"), buckets=1), "abcdefgh"
    monkeypatch.setattr(box, "SLICE", 60)
    r = lambda *days: spark.createDataFrame([(k, at(d)) for k in [None, *keys] for d in days], "key string, ts timestamp")
    t = lambda rows: spark.createDataFrame([(u, k, at(d)) for u, k, d in rows], "user string, key string, at timestamp")
    box.merge(0, r(5), t([("u", k, 1) for k in keys]))
    slice_, done = box._slice, []

    def cut_off(*rows):
        assert not done, "cut off"
        done.append(box.sent.path)
        return slice_(*rows)

    toggles = t([(u, k, d) for k in keys for u, d in (("v", 6), ("v", 6), ("w", 2))] + [("u", k, 7) for k in "abcd"])
    box._slice = cut_off
    with pytest.raises(AssertionError, match="cut off"):
        box.merge(1, r(5, 9), toggles)
    box._slice = slice_
    box.merge(1, r(5, 9), toggles)
    want = [(k, d, u) for k in keys for d, u in ((5, "u"), (5, "w"), (9, "v"), (9, "w"))] + [(k, 9, "u") for k in "efgh"]
    assert sorted((x.key, x.ts.day, x.user) for x in box.read().collect()) == sorted(want)


def test_redeliveries_within_the_watermark(spark, tmp_path):
    rows = [("e1", dt.datetime(2024, 1, 1)), ("e1", dt.datetime(2024, 1, 2)), ("e2", dt.datetime(2024, 1, 2))]
    for i, part in enumerate((rows, [("e2", dt.datetime(2024, 1, 3)), ("e3", dt.datetime(2024, 1, 3))])):
        spark.createDataFrame(part, "event_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    source = spark.readStream.schema("event_id string, ts timestamp, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = billing_stream.deduplicated(source.drop("p")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["e1", "e2", "e3"]


def test_quiz_answers_are_dealt(spark, sf_dir):
    """The customers lie in one row group; their answers are summed by as many tasks as there are cores."""
    from workload import people
    assert people._answers(spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
