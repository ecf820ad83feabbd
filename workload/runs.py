"""Queries that write tables and read them back: logs, streams into tables, exports, backups, landed files."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.text import fix_entities
from tallyshelf.operators import catalogue, diff, dims, userlog
from tallyshelf.plans import publish
from tallyshelf.operators.pages import numbered
from tallyshelf.session import settle
from tallyshelf.sinks import tables
from tallyshelf.sinks.buckets import BucketTable
from tallyshelf.sources import dims as dim_sources
from tallyshelf.sources import feeds
from tallyshelf.streaming import alerts, billing_stream, diff_stream, keyed_stream
from workload import standins as S
from workload.feeds import SQL_GOODS, _goods, _packed, _run_folder
from workload.people import SQL_BILLING, SQL_LOG, billing_events
from workload.registry import query, with_
from workload.tracking import SQL_EVENTS, SQL_ITEM_OF, SQL_STATE, _diff, _named


def _events(spark, sf):
    return _diff(spark, sf).select(F.col("key").cast("string").alias("key"), "type", F.col("ts").cast("timestamp").alias("ts"), "oos_hours")


@query(with_(SQL_EVENTS, body="""SELECT CAST(d.key AS VARCHAR) AS key, d.type, d.ts, d.oos_hours, c.c_name AS title
  FROM diff d JOIN customer c ON d.key = c.c_custkey WHERE d.ts > TIMESTAMP '2024-01-31' - INTERVAL 14 DAY"""))
def event_log_recent(spark, sf):
    """The log written twice under one batch id and read from its day folders since the cut."""
    path = f"{_run_folder(spark)}/events"
    for _ in range(2):
        tables.append_events(_events(spark, sf), path, batch=0)
    products = S.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("title"))
    rows = diff.recent_events(tables.read_events(spark, path), products, F.lit("2024-01-31").cast("timestamp"))
    return rows.drop("event_date").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_STATE = "key string, available boolean, first_seen timestamp, last_seen timestamp, last_status_change timestamp"


def _observations(spark, sf):
    return S.snapshots(spark, sf).select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "available")


@query(with_(SQL_EVENTS, SQL_STATE, body="""SELECT key::VARCHAR AS key, available, first_seen, last_seen, last_status_change,
  (SELECT count(*) FROM diff WHERE diff.key = state.key) AS n_events FROM state"""))
def state_in_buckets(spark, sf):
    """Twenty batches of snapshots merged one after another, each of them sent twice."""
    folder = _run_folder(spark)
    rows = settle(_observations(spark, sf).withColumn("day", F.dayofmonth("ts")))
    state = BucketTable(spark, f"{folder}/state", _STATE, buckets=8, deltas=4)
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    for batch in range(20):
        low, high = (first + (last + 1 - first) * k / 20 for k in (batch, batch + 1))
        for _ in range(2):
            diff_stream.merge_snapshots(state, rows.filter((F.col("day") >= low) & (F.col("day") < high)).drop("day"), f"{folder}/events", batch)
    counts = tables.read_events(spark, f"{folder}/events").groupBy("key").agg(F.count(F.lit(1)).alias("n_events"))
    out = state.read().join(counts, "key", "left").na.fill(0, ["n_events"])
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])


@query(with_(SQL_EVENTS, """cut AS (SELECT key, max(ts) AS seen FROM snap WHERE ts < TIMESTAMP '2024-01-20' GROUP BY key)""",
             body="""SELECT 'late' AS kind, snap.key::VARCHAR AS key, count(*) AS n FROM snap JOIN cut ON snap.key = cut.key AND snap.ts < seen
    WHERE snap.key % 3 = 0 GROUP BY ALL
  UNION ALL SELECT type, key::VARCHAR, count(*) FROM diff GROUP BY ALL"""))
def late_snapshots(spark, sf):
    """The second of two batches brings a third of the keys' old snapshots again, which count as late and change nothing."""
    folder = _run_folder(spark)
    rows = _observations(spark, sf)
    state = BucketTable(spark, f"{folder}/state", _STATE, buckets=8)
    new = F.col("ts") >= F.lit("2024-01-20").cast("timestamp")
    for batch, part in enumerate([~new, new | (F.col("key").cast("bigint") % 3 == 0)]):
        diff_stream.merge_snapshots(state, rows.filter(part), f"{folder}/events", batch, late_path=f"{folder}/late")
    late = spark.read.parquet(f"{folder}/late").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    events = tables.read_events(spark, f"{folder}/events").groupBy("type", "key").agg(F.count(F.lit(1)).alias("n"))
    return late.select(F.lit("late").alias("kind"), "key", "n").unionAll(events)


@query(with_(SQL_EVENTS, """runs AS (SELECT key, available, changed, lead(changed) OVER (PARTITION BY key ORDER BY ts) AS next FROM marked WHERE changed IS NOT NULL)""",
             body="""SELECT key::VARCHAR AS key, type, ts, oos_hours, NULL::BIGINT AS n FROM diff
  UNION ALL SELECT key::VARCHAR, 'archive', changed + INTERVAL 36 HOUR, NULL, NULL FROM runs
    WHERE NOT available AND epoch_us(coalesce(next, TIMESTAMP '2024-03-15')) - epoch_us(changed) >= 36 * 3600 * 1000000::BIGINT
  UNION ALL SELECT NULL, 'late', NULL, NULL, count(*) FROM snap WHERE key % 3 = 0 AND day(ts) < 5"""))
def keyed_stock_stream(spark, sf):
    """Three runs of one stream out of one checkpoint. Half the rows of a run's last day come with the next run, the last run
    brings old rows again, which count as late, and a row that only moves time on."""
    folder = _run_folder(spark)
    rows = settle(_observations(spark, sf).withColumn("at", F.floor((F.dayofmonth("ts") + F.pmod(F.xxhash64("key", "ts"), F.lit(2))) / 11)))
    again = rows.filter((F.dayofmonth("ts") < 5) & (F.col("key").cast("bigint") % 3 == 0)).withColumn("at", F.lit(2))
    beat = spark.range(1).select(F.lit(None).cast("string").alias("key"), F.lit("2024-03-15").cast("timestamp").alias("ts"),
                                 F.lit(None).cast("boolean").alias("available"), F.lit(2).alias("at"))
    sent, late = rows.unionByName(again).unionByName(beat), 0
    for number in range(3):
        sent.filter(F.col("at") == number).drop("at").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("key string, ts timestamp, available boolean").parquet(f"{folder}/in")
        run = keyed_stream.start_keyed(keyed_stream.keyed_events(stream, "2 days", archive_days=1.5, slot_hours=24), f"{folder}/out", f"{folder}/cp")
        run.awaitTermination()
        late += keyed_stream.dropped_late(run)
    events = spark.read.schema(keyed_stream.EVENTS).parquet(f"{folder}/out").select(
        "key", "type", F.col("ts").cast("timestamp_ntz").alias("ts"), "oos_hours", F.lit(None).cast("bigint").alias("n"))
    counted = spark.range(1).select(F.lit(None).cast("string").alias("key"), F.lit("late").alias("type"), F.lit(None).cast("timestamp_ntz").alias("ts"),
                                    F.lit(None).cast("double").alias("oos_hours"), F.lit(late).cast("bigint").alias("n"))
    return events.unionByName(counted)


@query(with_(SQL_EVENTS, SQL_STATE, body="""SELECT key::VARCHAR AS key, available, last_seen,
  row_number() OVER (ORDER BY last_seen DESC, key::VARCHAR) AS nth FROM state"""))
def state_newest_first(spark, sf):
    """The whole state table, numbered as it is read: newest first."""
    folder = _run_folder(spark)
    state = BucketTable(spark, f"{folder}/state", _STATE)
    diff_stream.merge_snapshots(state, _observations(spark, sf), f"{folder}/events", 0)
    rows = numbered(dim_sources.newest_first(state.read()), [F.desc("last_seen"), F.asc("key")], "nth")
    return rows.select("key", "available", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "nth")


@query(with_(SQL_BILLING, body="SELECT user_id, plan, status, current_period_end, customer_id, subscription_id, updated_at FROM ent"))
def entitlement_stream(spark, sf):
    """Three batches out of order, each event's month deciding; repeats come along, some in a later batch."""
    folder = _run_folder(spark)
    rows = billing_events(spark, sf)
    rows = settle(rows.select(*[F.col(c).cast("timestamp").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in rows.dtypes]))
    table = billing_stream.Entitlements(spark, f"{folder}/table")
    third = F.month("ts") % 3
    for number, part in enumerate([third == 1, (third == 0) | ((third == 1) & (F.dayofmonth("ts") < 5)), third == 2]):
        table.merge(rows.filter(part), number)
    out = table.read().na.fill("", ["subscription_id"])
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])


@query(with_(SQL_EVENTS, SQL_ITEM_OF, """picked AS (SELECT *, (day(ts) // 8)::BIGINT AS batch, type = 'new' AS rare FROM named
    WHERE type = 'restock' OR (type = 'new' AND regexp_matches(title, '(?i)\\bgeisha\\b|cup of excellence'))),
  s AS (SELECT batch, count(*) FILTER (NOT rare) AS a, count(*) FILTER (rare) AS b, arg_max(title || ' — ' || shop, (ts, -key)) FILTER (NOT rare) AS ra,
    arg_max(oos_hours, (ts, -key)) FILTER (NOT rare) AS h, arg_max(title || ' — ' || shop, (ts, -key)) FILTER (rare) AS rb FROM picked GROUP BY batch)""",
             body="""SELECT batch, CASE WHEN a = 1 AND b = 0 THEN '再入荷しました' WHEN b = 1 AND a = 0 THEN 'レアロットが入りました'
      ELSE concat_ws('・', CASE WHEN a > 0 THEN '再入荷 ' || a || '件' END, CASE WHEN b > 0 THEN '新着レアロット ' || b || '件' END) END AS title,
    CASE WHEN a = 1 AND b = 0 THEN ra || '（約' || CAST(round_even(h / 24, 0) AS BIGINT) || '日ぶり）' WHEN b = 1 AND a = 0 THEN rb ELSE coalesce(rb, ra) || ' ほか' END AS body,
    CASE WHEN b > 0 THEN '?v=geisha' ELSE '?v=zukan' END AS url, CASE WHEN a = 1 AND b = 0 THEN 'restock' WHEN b = 1 AND a = 0 THEN 'rare' ELSE 'digest' END AS tag FROM s"""))
def digest_stream(spark, sf):
    """One message for each batch of eight days; every batch is sent through twice."""
    folder = _run_folder(spark)
    events = settle(_events(spark, sf))
    products = settle(_named(_diff(spark, sf)).select(F.col("key").cast("string").alias("key"), "title", "shop").distinct())
    for number in range(4):
        for _ in range(2):
            alerts.write_digest(events.filter(F.floor(F.dayofmonth("ts") / 8) == number), products, f"{folder}/out", number)
    return spark.read.parquet(f"{folder}/out").withColumn("batch", F.col("batch").cast("bigint"))


#: Watches that one task makes, and users that are sent to all tasks at once.
_WATCHES, _USERS = 1_000_000, 500_000


def _watches(spark, sf):
    """Every customer watches the keys of its nation. They lie by key, in as many parts as their number asks for: the users come
    to the keys in blocks of a fixed size, however many there are, so that no watch is shuffled to its key."""
    keys = S.snapshots(spark, sf).select("key").distinct().withColumn("n", F.pmod("key", F.lit(25)).cast("bigint"))
    users = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").cast("bigint").alias("n"))
    sizes = users.groupBy("n").agg(F.count(F.lit(1)).alias("b")).join(keys.groupBy("n").agg(F.count(F.lit(1)).alias("a")), "n", "left")
    total, most = sizes.agg(F.sum(F.col("a") * F.col("b")), F.sum("b")).first()
    parts, blocks = max(spark.sparkContext.defaultParallelism, (total or 0) // _WATCHES), max(1, ceil((most or 0) / _USERS))
    keys, block = keys.repartition(parts, "key"), F.pmod(F.xxhash64("user", "n"), F.lit(blocks))
    return reduce(DataFrame.unionAll, [keys.join(F.broadcast(users.filter(block == k)), "n").select("user", "key") for k in range(blocks)])


@query(with_(SQL_EVENTS, body="""SELECT d.key, d.ts, c.c_custkey AS "user" FROM diff d JOIN customer c ON c.c_nationkey = d.key % 25 WHERE d.type = 'restock'"""))
def restock_alerts(spark, sf):
    """Every customer watches the keys of its nation; each event is delivered twice."""
    events = _diff(spark, sf)
    return alerts.restock_alerts(events.unionAll(events), _watches(spark, sf)).select("key", "ts", "user")


@query(with_(SQL_EVENTS, """w AS (SELECT c_custkey AS c, k.key FROM customer JOIN (SELECT DISTINCT key FROM snap) k ON k.key % 25 = c_nationkey)""",
             body="""SELECT d.key::VARCHAR AS key, d.ts, w.c::VARCHAR AS "user" FROM diff d JOIN w ON w.key = d.key WHERE d.type = 'restock'
  AND d.ts >= TIMESTAMP '2024-01-02' AND (w.c % 2 = 1 OR d.ts < TIMESTAMP '2024-01-20')"""))
def changing_watches(spark, sf):
    """Watches go on, and half of them off again; a third of the customers' toggles come last, and restocks come twice."""
    alerts_ = alerts.RestockAlerts(spark, f"{_run_folder(spark)}/alerts", buckets=8)
    restocks = settle(_events(spark, sf).filter("type = 'restock'").select("key", "ts"))
    pairs = _watches(spark, sf).withColumn("key", F.col("key").cast("string"))
    on, off = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    times = F.when(F.col("user") % 2 == 0, F.array(on, off)).otherwise(F.array(on))
    toggles = pairs.select("user", "key", F.explode(times).alias("at"))
    late, early = F.col("user") % 3 == 0, F.col("ts") < F.lit("2024-01-12").cast("timestamp")
    alerts_.merge(0, restocks.filter(early), toggles.filter(~late))
    alerts_.merge(1, restocks, toggles.filter(~late & (F.col("user") % 5 == 0)))
    alerts_.merge(2, restocks.filter("false"), toggles.filter(late))
    return alerts_.read().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(with_(SQL_GOODS, body="""SELECT shop || '::p' || k AS key, title, price, CASE WHEN size % 3 = 0 THEN 0 ELSE size * 10 END AS grams,
    CASE WHEN size % 3 <> 0 THEN printf('%.2f', price / (size * 10) * 100)::DOUBLE ELSE -1 END AS per100, size % 2 = 0 AS available, origin, process, notes FROM known"""))
def snapshot_files(spark, sf):
    """Shop documents of forty goods each, written as JSON and read as a snapshot."""
    sold_out = F.struct(F.lit("1").alias("price"), F.lit(5).alias("grams"), F.lit(False).alias("available"))
    variant = F.struct(F.col("price"), F.when(F.col("size") % 3 == 0, 0).otherwise(F.col("size") * 10).alias("grams"), (F.col("size") % 2 == 0).alias("available"))
    entry = F.struct(F.concat(F.lit("p"), "k").alias("handle"), "title", F.array().cast("array<string>").alias("tags"), F.col("body").alias("body_html"),
                     F.when(F.col("size") % 2 == 0, F.array(sold_out, variant)).otherwise(F.array(variant)).alias("variants"))
    head = F.struct(F.col("shop").alias("name"), F.lit("JP").alias("country"), F.lit("https://x.example").alias("url"), F.lit("JPY").alias("currency"))
    path = f"{_run_folder(spark)}/snapshot"
    _packed(_goods(spark, sf), entry).select(head.alias("_roaster"), "products").write.json(path)
    rows = feeds.read_snapshot(spark, path, lines=True)
    return rows.select("key", "title", "price", "grams", F.coalesce("per100", F.lit(-1.0)).alias("per100"), "available", "origin", "process", "notes")


def _two_feeds(spark, sf):
    """Odd parts come by one feed, even ones by the other; the brand of part 1 is asked for and silent."""
    goods = _goods(spark, sf).filter(F.col("shop") != "Brand#11")
    entry = F.struct(F.concat(F.lit("p"), "k").alias("handle"), "title", F.array(F.struct("price", (F.col("size") % 2 == 0).alias("available"))).alias("variants"))
    one = _packed(goods.filter("k % 2 = 1"), entry).select("shop", F.lit("JP").alias("country"), F.lit("https://x.example").alias("url"),
                                                           F.lit("JPY").alias("currency"), F.to_json(F.struct("products")).alias("body"))
    other = F.struct(F.col("k").alias("id"), F.col("title").alias("name"), (F.col("size") % 2 == 0).alias("is_in_stock"),
                     F.struct(F.replace("price", F.lit("."), F.lit("")).alias("price")).alias("prices"))
    two = _packed(goods.filter("k % 2 = 0"), other).select("shop", F.lit("JP").alias("country"), F.lit("https://x.example").alias("url"),
                                                           F.lit("JPY").alias("currency"), F.to_json("products").alias("body"))
    return feeds.union_feeds(feeds.normalise_shop_json(one), feeds.normalise_store_json(two))


SQL_TWO = "two AS (SELECT p_brand AS shop, p_partkey AS k, p_retailprice AS price, p_size % 2 = 0 AS available FROM part WHERE p_brand <> 'Brand#11')"


@query(with_(SQL_TWO, body="""SELECT shop || CASE WHEN k % 2 = 1 THEN '::p' ELSE '::' END || k AS key, shop, price, available FROM two
  UNION ALL SELECT NULL, p_brand, NULL, NULL FROM part WHERE p_brand NOT IN (SELECT shop FROM two) GROUP BY p_brand"""))
def union_of_feeds(spark, sf):
    rows = _two_feeds(spark, sf)
    failed = feeds.failed_shops(S.table(spark, sf, "part").select(F.col("p_brand").alias("shop")), rows)
    return rows.select("key", "shop", "price", "available").unionByName(failed, allowMissingColumns=True)


@query(with_(SQL_TWO, body="""SELECT 'products' AS name, count(*) AS n FROM two UNION ALL SELECT 'in_stock', count(*) FILTER (available) FROM two
  UNION ALL SELECT 'shops', count(DISTINCT shop) FROM two UNION ALL SELECT 'failed', count(DISTINCT p_brand) FROM part WHERE p_brand NOT IN (SELECT shop FROM two)"""))
def site_export(spark, sf):
    rows = _two_feeds(spark, sf)
    failed = feeds.failed_shops(S.table(spark, sf, "part").select(F.col("p_brand").alias("shop")), rows)
    path = f"{_run_folder(spark)}/site"
    tables.export_site(rows, _events(spark, sf), catalogue.site_stats(rows).crossJoin(failed.agg(F.count(F.lit(1)).alias("failed"))), path)
    stats = spark.read.schema("products bigint, in_stock bigint, shops bigint, failed bigint").json(f"{path}/stats")
    return stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in stats.columns])))


@query(with_(S.sql_items(), S.sql_shops(), body="""SELECT 'items' AS kind, shop, count(*) AS n FROM items GROUP BY shop
  UNION ALL SELECT 'shops', shop, 1 FROM shops"""))
def overlay_export(spark, sf):
    path = f"{_run_folder(spark)}/overlay"
    items = S.items(spark, sf)
    products = items.select(F.col("id").alias("key"), "shop", F.col("name").alias("title"), "origin", "process", F.col("amount").alias("price"),
                            F.col("cur").alias("currency"), "grams", "status", F.col("updated_at").alias("first_seen"), "notes", "tags",
                            F.lit("").alias("image"), F.col("link").alias("url"))
    tables.export_overlay(publish.publish_items(products, F.lit("2024-01-01").cast("date")), S.shops(spark, sf), path)
    count = lambda name: spark.read.parquet(f"{path}/{name}").groupBy("shop").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("kind"), "shop", "n")
    return count("items").unionAll(count("shops"))


@query(with_(SQL_LOG, body="""SELECT 'log' AS kind, "user", item_id, max("at") AS "at" FROM log GROUP BY "user", item_id
  UNION ALL SELECT 'history', "user", NULL, "at" FROM (SELECT DISTINCT "user", "at" FROM log) QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY "at" DESC) <= 50"""))
def backup_import(spark, sf):
    """Odd events are on the device, all are in the backup: written as JSON, read, and merged."""
    log = S.ratings(spark, sf).select("user", "item_id", "at", "rating", "event_id")
    last = userlog.upsert_ratings(log.filter("false").drop("event_id"), log.drop("event_id"))
    here = userlog.upsert_ratings(log.filter("false").drop("event_id"), log.filter("event_id % 2 = 1").drop("event_id"))
    path = f"{_run_folder(spark)}/backup"
    tables.export_backup(last, path)
    backup = spark.read.schema("user bigint, item_id bigint, at bigint, rating int").json(path)
    merged = userlog.import_backup(here, backup).select(F.lit("log").alias("kind"), "user", "item_id", "at")
    times = log.select("user", "at").distinct()
    history = userlog.import_history(log.filter("event_id % 2 = 1").select("user", "at").distinct(), times, cap=50)
    return merged.unionByName(history.select(F.lit("history").alias("kind"), "user", F.lit(None).cast("bigint").alias("item_id"), "at"))


@query(with_(SQL_LOG, body="""SELECT "user", item_id, "at" FROM log WHERE event_id % 2 = 0
  UNION ALL SELECT l."user", l.item_id, l."at" FROM log l WHERE event_id % 2 = 1 AND l."user" NOT IN (SELECT "user" FROM log WHERE event_id % 2 = 0)"""))
def adopted_log(spark, sf):
    """Odd events were made on a device of their user before the login."""
    log = S.ratings(spark, sf).select("user", "item_id", "at", "event_id")
    device = F.concat(F.lit("d"), "user")
    anonymous = log.filter("event_id % 2 = 1").select(device.alias("device"), "item_id", "at")
    logins = log.select(device.alias("device"), "user").distinct()
    return userlog.adopt_anonymous(log.filter("event_id % 2 = 0").drop("event_id"), anonymous, logins)


@query(with_(S.sql_items(), body="SELECT shop, count(DISTINCT id) AS n_keys, count(DISTINCT id) AS n_ids, count(DISTINCT id) AS n_same FROM items GROUP BY shop"))
def stable_ids(spark, sf):
    """Ids of two separate runs: as many as keys, and each key's the same in both."""
    keys = S.items(spark, sf).select("shop", F.col("id").alias("key"))
    one = keys.withColumn("one", dims.stable_id("key"))
    two = keys.repartition(5).select("key", dims.stable_id("key").alias("two"))
    return one.join(two, "key").groupBy("shop").agg(
        F.countDistinct("key").alias("n_keys"), F.countDistinct("one").alias("n_ids"),
        F.countDistinct(F.when(F.col("one") == F.col("two"), F.col("key"))).alias("n_same"))


@query("""SELECT p_partkey, p_name || ' - "A" & B & #x' AS title FROM part""")
def entity_titles(spark, sf):
    title = F.concat("p_name", F.lit(' &#8211; "A" &#038; B &amp; #x'))
    return S.table(spark, sf, "part").select("p_partkey", fix_entities(title).alias("title"))


@query("SELECT 'city ' || c_custkey || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'JP' ELSE 'US' END AS city_key, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 0.5 END::DOUBLE AS lon FROM customer")
def cached_cities(spark, sf):
    """Every customer's place, cached in files by hash, with a file that is missing beside them."""
    key = F.concat(F.lit("city "), "c_custkey", F.lit("|"), F.when(F.col("c_custkey") % 2 == 0, "JP").otherwise("US"))
    point = F.when(F.col("c_custkey") % 3 != 0, F.array(F.col("c_custkey") * 0.5, F.lit(1.0)))
    rows = S.table(spark, sf, "customer")
    files = max(1, rows.count() // 200)
    text = F.to_json(F.map_from_entries(F.collect_list(F.struct(key, point))), {"ignoreNullFields": "false"})
    path = _run_folder(spark)
    packed = rows.groupBy(F.pmod(F.xxhash64("c_custkey"), F.lit(files)).alias("file")).agg(text.alias("value"))
    packed.repartition("file").write.partitionBy("file").text(f"{path}/cache")
    found = dim_sources.read_city_cache(spark, f"{path}/cache").unionAll(dim_sources.read_city_cache(spark, f"{path}/none"))
    return found.select("city_key", "lon")
