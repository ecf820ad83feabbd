"""Tracking queries: snapshot differences, stock state, event listings, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyshelf.functions import price
from tallyshelf.functions.status import is_recent, stock_status
from tallyshelf.operators import catalogue, diff, digest
from workload import standins as S
from workload.registry import query, with_

NOW = "2024-02-13"

SQL_EVENTS = S.SQL_SNAPSHOTS + """,
steps AS (SELECT *, lag(available) OVER (PARTITION BY key ORDER BY ts) AS prev FROM snap),
marked AS (SELECT *, CASE WHEN prev IS NULL OR prev <> available THEN ts END AS changed FROM steps),
since AS (SELECT *, last_value(changed IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM marked),
ev AS (SELECT key, ts, CASE WHEN prev IS NULL AND available THEN 'new'
    WHEN available AND NOT prev AND (epoch_us(ts) - epoch_us(since)) / 3.6e9 >= 12 THEN 'restock'
    WHEN NOT available AND prev THEN 'soldout' END AS type,
  CASE WHEN available AND NOT prev THEN printf('%.1f', (epoch_us(ts) - epoch_us(since)) / 3.6e9)::DOUBLE END AS oos_hours
  FROM since),
diff AS (SELECT key, type, ts, oos_hours FROM ev WHERE type IS NOT NULL)"""

SQL_STATE = """state AS (SELECT key, max_by(available, ts) AS available, min(ts) AS first_seen, max(ts) AS last_seen,
  max(changed) AS last_status_change FROM marked GROUP BY key)"""

SQL_ITEM_OF = """named AS (SELECT d.*, 'u' || d.key AS shop, CASE d.key % 4 WHEN 0 THEN 'Panama Geisha' WHEN 1 THEN 'House Blend'
    WHEN 2 THEN 'Cup of Excellence #12' ELSE 'Kenya AA' END AS title, 'https://shop.example.com/' || d.key AS url FROM diff d)"""


def _diff(spark, sf):
    return diff.snapshot_diff(S.snapshots(spark, sf))


def _named(events):
    title = S.choose(["Panama Geisha", "House Blend", "Cup of Excellence #12", "Kenya AA"], F.col("key"))
    return events.select("*", F.concat(F.lit("u"), "key").alias("shop"), title.alias("title"),
                         F.concat(F.lit("https://shop.example.com/"), "key").alias("url"))


@query(with_(SQL_EVENTS, body="SELECT * FROM diff"))
def snapshot_events(spark, sf):
    return _diff(spark, sf)


@query(with_(SQL_EVENTS, SQL_STATE, body=f"""SELECT *, CASE WHEN available THEN 'now'
  WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_status_change) >= 14 * 86400 * 1000000::BIGINT THEN 'archive' ELSE 'sold' END AS status FROM state"""))
def stock_state(spark, sf):
    state = diff.replay_state(S.snapshots(spark, sf))
    now = F.lit(NOW).cast("timestamp_ntz")
    return state.withColumn("status", stock_status(F.col("available"), F.col("last_status_change"), now))


def _state_and_snapshot(spark, sf):
    """State before a day, and each key's last observation from that day on as one snapshot."""
    rows = S.snapshots(spark, sf)
    cut = F.lit("2024-01-25").cast("timestamp_ntz")
    state = diff.replay_state(rows.filter(F.col("ts") < cut))
    late = rows.filter(F.col("ts") >= cut).withColumnRenamed("ts", "at")
    return state, late


SQL_APPLY = """snap AS (SELECT user_id AS key, ts, event_type <> 'error' AS available FROM events WHERE ts < TIMESTAMP '2024-01-25'),
late AS (SELECT user_id AS key, max_by(event_type <> 'error', ts) AS available FROM events
  WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1)"""
SQL_APPLY_JOIN = """j AS (SELECT coalesce(s.key, l.key) AS key, s.available AS was, l.available AS is_, s.first_seen, s.last_seen,
  s.last_status_change AS chg, TIMESTAMP '2024-02-01' AS now FROM state s FULL JOIN late l ON s.key = l.key)"""


def _apply_sql(body: str) -> str:
    tail = SQL_EVENTS[SQL_EVENTS.index("steps AS"):SQL_EVENTS.index("since AS")].rstrip().rstrip(",")
    return with_(SQL_APPLY, tail, SQL_STATE, SQL_APPLY_JOIN, body=body)


@query(_apply_sql("""SELECT key, coalesce(is_, was) AS available, coalesce(first_seen, now) AS first_seen,
  CASE WHEN is_ IS NULL THEN last_seen ELSE now END AS last_seen,
  CASE WHEN is_ IS NULL OR is_ = was THEN chg ELSE now END AS last_status_change FROM j"""))
def upsert_state(spark, sf):
    state, late = _state_and_snapshot(spark, sf)
    return diff.apply_snapshot(state, late, F.lit("2024-02-01").cast("timestamp_ntz"), order="at")[0]


@query(_apply_sql("""SELECT key, type, now AS ts, CASE WHEN type = 'restock' THEN h END AS oos_hours FROM (
  SELECT key, now, printf('%.1f', (epoch_us(now) - epoch_us(chg)) / 3.6e9)::DOUBLE AS h, CASE WHEN was IS NULL AND is_ THEN 'new'
    WHEN is_ AND NOT was AND (epoch_us(now) - epoch_us(chg)) / 3.6e9 >= 12 THEN 'restock'
    WHEN NOT is_ AND was THEN 'soldout' END AS type FROM j) WHERE type IS NOT NULL"""))
def upsert_events(spark, sf):
    state, late = _state_and_snapshot(spark, sf)
    return diff.apply_snapshot(state, late, F.lit("2024-02-01").cast("timestamp_ntz"), order="at")[1]


def _continued(spark, sf):
    """The second part of the history applied at once to the state the first part left."""
    rows = S.snapshots(spark, sf)
    cut = F.lit("2024-01-25").cast("timestamp_ntz")
    return diff.apply_history(diff.replay_state(rows.filter(F.col("ts") < cut)), rows.filter(F.col("ts") >= cut))


@query(with_(SQL_EVENTS, SQL_STATE, body="SELECT * FROM state"))
def continued_state(spark, sf):
    return _continued(spark, sf)[0]


@query(with_(SQL_EVENTS, body="SELECT * FROM diff WHERE ts >= TIMESTAMP '2024-01-25'"))
def continued_events(spark, sf):
    return _continued(spark, sf)[1]


@query(with_(SQL_EVENTS, body="""SELECT d.key, d.type, d.ts, d.oos_hours, c.c_name AS title, c.c_mktsegment AS shop
  FROM diff d JOIN customer c ON d.key = c.c_custkey WHERE d.ts > TIMESTAMP '2024-01-31' - INTERVAL 14 DAY
"""))
def recent_events(spark, sf):
    products = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("shop"))
    return diff.recent_events(_diff(spark, sf), products, F.lit("2024-01-31").cast("timestamp_ntz"))


@query(with_(SQL_EVENTS, SQL_STATE, body="""SELECT type, count(*) AS n FROM diff GROUP BY 1
  UNION ALL SELECT 'all', count(*) FILTER (available) FROM state"""))
def event_counts(spark, sf):
    rows = S.snapshots(spark, sf)
    return diff.event_counts(diff.snapshot_diff(rows), diff.replay_state(rows))


@query(with_(SQL_EVENTS, SQL_ITEM_OF, body="""SELECT key, type, ts, title, type = 'new' AS rare FROM named
  WHERE type = 'restock' OR (type = 'new' AND regexp_matches(title, '(?i)\\b(geisha|gesha|sidra)\\b|cup of excellence|\\bcoe\\b'))"""))
def digest_events(spark, sf):
    return digest.pick_events(_named(_diff(spark, sf))).select("key", "type", "ts", "title", "rare")


@query(with_(SQL_EVENTS, SQL_ITEM_OF, """picked AS (SELECT *, date_trunc('hour', ts) AS run, type = 'new' AS rare FROM named
    WHERE type = 'restock' OR (type = 'new' AND regexp_matches(title, '(?i)\\bgeisha\\b|cup of excellence'))),
  sums AS (SELECT run, count(*) FILTER (NOT rare) AS a, count(*) FILTER (rare) AS b,
    arg_max(title || ' — ' || shop, ts) FILTER (NOT rare) AS ra, arg_max(oos_hours, ts) FILTER (NOT rare) AS h,
    arg_max(title || ' — ' || shop, ts) FILTER (rare) AS rb FROM picked GROUP BY run)""", body="""
  SELECT run, CASE WHEN a = 1 AND b = 0 THEN '再入荷しました' WHEN b = 1 AND a = 0 THEN 'レアロットが入りました'
      ELSE concat_ws('・', CASE WHEN a > 0 THEN '再入荷 ' || a || '件' END, CASE WHEN b > 0 THEN '新着レアロット ' || b || '件' END) END AS title,
    CASE WHEN a = 1 AND b = 0 THEN ra || '（約' || CAST(round_even(h / 24, 0) AS BIGINT) || '日ぶり）' WHEN b = 1 AND a = 0 THEN rb
      ELSE coalesce(rb, ra) || ' ほか' END AS body,
    CASE WHEN b > 0 THEN '?v=geisha' ELSE '?v=zukan' END AS url,
    CASE WHEN a = 1 AND b = 0 THEN 'restock' WHEN b = 1 AND a = 0 THEN 'rare' ELSE 'digest' END AS tag FROM sums"""))
def push_messages(spark, sf):
    events = _named(_diff(spark, sf)).withColumn("run", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return digest.push_message(events, [-F.unix_micros(F.col("ts").cast("timestamp")), F.col("key")], group=["run"])


@query(with_(SQL_EVENTS, SQL_ITEM_OF, """head AS (SELECT * FROM named WHERE type IN ('new', 'restock') ORDER BY ts DESC, key LIMIT 15)""",
  body="""SELECT string_agg(CASE type WHEN 'new' THEN '⤴ 新着' ELSE '↻ 再入荷' END || ' **' || title || '** — ' || shop || ' '
    || CASE WHEN oos_hours > 0 THEN '（約' || CAST(round_even(oos_hours / 24, 1) AS VARCHAR) || '日ぶり）' ELSE '' END
    || chr(10) || '<' || url || '>', chr(10) ORDER BY ts DESC, key)[1:1900] AS content FROM head"""))
def long_digest(spark, sf):
    fresh = diff.fresh_events(_named(_diff(spark, sf)), F.lit("2023-12-31").cast("timestamp_ntz"))
    return digest.long_digest(fresh, [F.desc("ts"), F.asc("key")])


def _products(spark, sf):
    """Order lines as tracked products."""
    items = S.items(spark, sf)
    return items.select(
        F.col("id").alias("key"), "shop", F.col("name").alias("title"), F.nullif("origin", F.lit("")).alias("origin"),
        "process", "tags", (F.col("status") == "now").alias("available"), F.col("amount").alias("price"),
        F.col("cur").alias("currency"), F.col("grams").cast("int").alias("grams"), "notes",
        price.per100(F.col("amount"), F.col("grams")).alias("per100"), F.col("updated_at").alias("last_seen"),
    )


SQL_PRODUCTS = S.sql_items() + """,
products AS (SELECT id AS key, shop, name AS title, nullif(origin, '') AS origin, process, status = 'now' AS available, amount AS price,
  cur AS currency, grams, notes, updated_at AS last_seen, CASE WHEN amount <> 0 THEN printf('%.2f', amount / grams * 100)::DOUBLE END AS per100 FROM items)"""


@query(with_(SQL_PRODUCTS, body="""SELECT key, shop, title, per100 FROM products WHERE available AND shop = 's7'
  AND lower(concat_ws(' ', title, shop, coalesce(origin, ''), process, '')) LIKE '%washed%'
  ORDER BY coalesce(per100, 1e9), key LIMIT 200"""))
def site_listing(spark, sf):
    products = _products(spark, sf)
    rows = catalogue.site_rows(products, products, "all", shop="s7", query="Washed", sort="cheap")
    return rows.select("key", "shop", "title", "per100")


@query(with_(SQL_PRODUCTS, body="""SELECT key, per100, row_number() OVER (ORDER BY coalesce(per100, -1) DESC, key) AS place FROM products
  WHERE available AND origin = 'エチオピア' QUALIFY place <= 200"""))
def site_pricey(spark, sf):
    """Dearest first, those without a price last, ties by key; numbered as they come."""
    products = _products(spark, sf)
    rows = catalogue.site_rows(products, products, "all", origin="エチオピア", sort="pricey")
    return rows.withColumn("place", F.monotonically_increasing_id() + 1).select("key", "per100", "place")


@query(with_(SQL_EVENTS, body="""SELECT key, oos_hours, row_number() OVER (ORDER BY ts DESC, key) AS place FROM diff WHERE type = 'restock' QUALIFY place <= 200"""))
def site_newest(spark, sf):
    """The newest restocks, numbered as they come."""
    events = _diff(spark, sf)
    rows = catalogue.site_rows(events, events, "restock", sort="newest")
    return rows.withColumn("place", F.monotonically_increasing_id() + 1).select("key", "oos_hours", "place")


@query(with_(SQL_PRODUCTS, body="""SELECT DISTINCT 'shop' AS field, shop AS value FROM products
  UNION SELECT 'origin', origin FROM products WHERE origin <> ''"""))
def filter_values(spark, sf):
    return catalogue.filter_values(_products(spark, sf))


@query(with_(SQL_PRODUCTS, body="""SELECT count(*) AS products, count(*) FILTER (available) AS in_stock,
  count(DISTINCT shop) AS shops FROM products"""))
def site_stats(spark, sf):
    return catalogue.site_stats(_products(spark, sf))


@query(with_(SQL_PRODUCTS, body="""SELECT count(*) AS products, count(*) FILTER (trim(coalesce(notes, '')) <> '') AS noted,
  round_even(count(*) FILTER (trim(coalesce(notes, '')) <> '') / count(*) * 100, 1) AS pct FROM products"""))
def notes_coverage(spark, sf):
    return catalogue.notes_coverage(_products(spark, sf))


@query(with_(SQL_PRODUCTS, body="""SELECT 's' || c.s_suppkey * 2 AS shop, coalesce(n, 0) AS n, coalesce(a, 0) AS n_available, coalesce(p, 0) AS n_priced,
    coalesce(cur, '') AS currencies FROM supplier c LEFT JOIN (SELECT shop, count(*) AS n, count(*) FILTER (available) AS a,
    count(*) FILTER (available AND price <> 0 AND grams > 0) AS p, string_agg(DISTINCT currency, '/' ORDER BY currency) AS cur
    FROM products GROUP BY shop) x ON x.shop = 's' || c.s_suppkey * 2"""))
def probe_report(spark, sf):
    from tallyshelf.operators import dims

    candidates = S.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") * 2).alias("shop"))
    return dims.probe_report(candidates, _products(spark, sf))


@query("""SELECT event_id, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) < 86400000000
    AND epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) >= -3600000000 AS recent FROM events""")
def recently_added(spark, sf):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return S.table(spark, sf, "events").select("event_id", is_recent(F.col("ts"), now).alias("recent"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_quantity > 0 THEN printf('%.2f', l_extendedprice / l_quantity * 100)::DOUBLE END AS per100 FROM lineitem""")
def unit_price(spark, sf):
    line = S.table(spark, sf, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       price.per100(F.col("l_extendedprice"), F.col("l_quantity")).alias("per100"))
