"""Queries on shop profiles, preferences, nearest items and user logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.operators import billing, catalogue, neighbours, preference, profile, userlog
from tallyshelf.functions.status import plan_is_paid
from tallyshelf.session import settle
from workload import standins as S
from workload.registry import query, with_

BASE = (S.sql_items(), S.sql_shops())
FEATURES = profile.FEATURES


def _stock(spark, sf):
    """Items in stock at known shops, with unit price and flags."""
    return catalogue.with_unit_price(S.flagged(S.items(spark, sf))).filter(F.col("status") == "now")


def _upper_median(value: str, table: str, group: str, name: str, where: str = "true") -> str:
    return f"""(SELECT {group}, max(v) FILTER (r = n // 2) AS {name} FROM (SELECT {group}, {value} AS v, row_number() OVER
      (PARTITION BY {group} ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY {group}) AS n FROM {table} WHERE {where}) GROUP BY {group})"""


SQL_TALLY = f"""stock AS (SELECT * FROM items WHERE status = 'now'),
  counts AS (SELECT shop, count(*) AS n, count(origin_group) AS n_origin, count(*) FILTER (origin_group = 'africa') AS africa,
    count(*) FILTER (origin_group = 'latam') AS latam, count(*) FILTER (origin_group = 'asia') AS asia,
    count(*) FILTER (process = 'Washed') AS clean, count(*) FILTER (process IN ('Natural', 'Honey')) AS "natural",
    count(*) FILTER (regexp_matches(process, 'Anaerobic|Carbonic')) AS experimental,
    count(*) FILTER (variety IN ('geisha', 'sidra')) AS geisha, arg_min(cur, id) AS cur FROM stock GROUP BY shop),
  tally AS (SELECT c.*, coalesce(p.price, 0) AS price FROM counts c LEFT JOIN
    {_upper_median('p100', 'stock', 'shop', 'price', 'p100 BETWEEN 100 AND 150000')} p USING (shop)),
  peers AS (SELECT a.cur, a.shops, b.peer FROM (SELECT cur, count(*) AS shops FROM tally GROUP BY cur) a LEFT JOIN
    {_upper_median('price', 'tally', 'cur', 'peer', 'price <> 0')} b USING (cur)),
  trust AS (SELECT t.*, coalesce(CASE WHEN price = 0 THEN false WHEN shops < 3 THEN true
    ELSE price BETWEEN peer / 3 AND peer * 3 END, false) AS trusted FROM tally t LEFT JOIN peers USING (cur))"""

_SHARE = "".join(
    f"""SELECT shop, '{f}' AS feature, ("{f}" + 8 * (SELECT sum("{f}") / sum({d}) FROM trust)) / ({d} + 8) AS value FROM trust UNION ALL """
    for f, d in [(f, "n_origin") for f in profile.ORIGIN_SHARES] + [(f, "n") for f in profile.STOCK_SHARES])
SQL_FEATURES = SQL_TALLY + f""",
  mid AS (SELECT middle FROM {_upper_median('price', 'trust', 'trusted', 'middle', 'trusted')}),
  feats AS ({_SHARE} SELECT shop, 'budget', coalesce(CASE WHEN trusted THEN -log2(price / (SELECT middle FROM mid)) END, 0) FROM trust
    UNION ALL SELECT shop, 'light', CASE style WHEN '極浅煎り' THEN 1 WHEN '浅煎り' THEN 0.9 WHEN '浅煎り〜中煎り' THEN 0.7 WHEN '中深煎り' THEN 0 ELSE 0.4 END
      FROM trust JOIN shops USING (shop)
    UNION ALL SELECT shop, 'medium', CASE WHEN style = '浅煎り〜中煎り' THEN 1 ELSE 0.4 END FROM trust JOIN shops USING (shop)
    UNION ALL SELECT shop, 'domestic', CASE WHEN country = 'JP' THEN 1 ELSE 0 END FROM trust JOIN shops USING (shop)),
  z AS (SELECT shop, feature, value, (value - avg(value) OVER (PARTITION BY feature))
      / CASE WHEN stddev_pop(value) OVER (PARTITION BY feature) = 0 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY feature) END AS z FROM feats)"""


@query(with_(*BASE, SQL_TALLY, body="""SELECT shop, n, n_origin, africa, latam, asia, clean, "natural", experimental, geisha, cur,
  round(price, 6) AS price FROM tally"""))
def shop_tally(spark, sf):
    t = profile.shop_tally(_stock(spark, sf), "seq")
    return t.select("shop", "n", "n_origin", "africa", "latam", "asia", "clean", "natural", "experimental", "geisha", "cur",
                    F.round("price", 6).alias("price"))


@query(with_(*BASE, SQL_TALLY, body="SELECT shop, cur, trusted FROM trust"))
def price_trust(spark, sf):
    return profile.price_trust(settle(profile.shop_tally(_stock(spark, sf), "seq"))).select("shop", "cur", "trusted")


@query(with_(*BASE, SQL_FEATURES, body="SELECT shop, feature, round(value, 7) AS value, round(z, 6) AS z FROM z"))
def shop_profiles(spark, sf):
    profiles, _ = profile.shop_profiles(_stock(spark, sf), S.shops(spark, sf), order="seq")
    return profiles.select("shop", "feature", F.round("value", 7).alias("value"), F.round("z", 6).alias("z"))


# --- preferences ------------------------------------------------------------------------------------

def _answers(spark, sf):
    """Quiz answers of every customer."""
    key = F.col("c_custkey")
    rows = F.array(*[F.struct(F.lit(q).alias("question"), F.pmod(key + q, F.lit(len(options))).cast("int").alias("option"))
                     for q, options in enumerate(rules.QUIZ)])
    return S.dealt(S.table(spark, sf, "customer").select("c_custkey")).select(key.alias("user"), F.inline(rows))


_OPTIONS = ", ".join(f"({q}, {o}, '{f}', {float(w)}, {len(options)})" for q, options in enumerate(rules.QUIZ)
                     for o, option in enumerate(options) for f, w in option.items())
SQL_ANSWERS = f"""options(question, opt, feature, w, n) AS (VALUES {_OPTIONS}),
  answers AS (SELECT c_custkey AS "user", feature, sum(w::DOUBLE) AS weight FROM customer JOIN options ON (c_custkey + question) % n = opt
    GROUP BY 1, 2)"""


@query("WITH " + SQL_ANSWERS + ' SELECT "user", feature, round(weight, 6) AS weight FROM answers')
def quiz_weights(spark, sf):
    return preference.answer_weights(_answers(spark, sf)).select("user", "feature", F.round("weight", 6).alias("weight"))


@query("WITH " + SQL_ANSWERS + ' SELECT "user", feature AS type FROM answers QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY weight DESC, feature) = 1')
def quiz_types(spark, sf):
    return preference.quiz_type(preference.answer_weights(_answers(spark, sf)))


SQL_LOG = f"""log AS (SELECT user_id AS "user", 1 + event_id % (SELECT count(*) FROM part) AS item_id,
    's' || (1 + event_id % (SELECT count(*) FROM supplier)) AS shop,
    CASE WHEN event_id % 5 = 0 THEN {S._pick(S.ORIGINS, 'event_id')} END AS origin, CAST(floor(value) AS INTEGER) % 6 AS rating,
    epoch_us(ts) // 1000 AS "at", ts, event_id FROM events),
  parts AS (SELECT p_partkey AS id, 's' || (1 + p_partkey % (SELECT count(*) FROM supplier)) AS shop, p_name AS name, {S._pick(S.ORIGINS, 'p_partkey')} AS origin,
    {S._pick(S.PROCESSES, 'p_partkey')} AS process, CASE WHEN p_partkey % 9 = 0 THEN 'geisha' END AS variety,
    {S._pick(["berry", "citrus", "choco"], 'p_partkey')} AS family, p_retailprice AS yen,
    CASE WHEN p_partkey % 3 = 0 THEN 'sold' ELSE 'now' END AS status FROM part)"""
SQL_TASTE = SQL_LOG + """,
  r AS (SELECT l."user", l.shop, coalesce(nullif(l.origin, ''), p.origin, '') AS o, coalesce(p.process, '') AS process, p.variety, p.family,
    s.country, s.region, (l.rating - 2.5) * 0.8::DOUBLE AS w FROM log l LEFT JOIN parts p ON l.item_id = p.id LEFT JOIN shops s ON s.shop = l.shop
    WHERE l.rating <> 0),
  rg AS (SELECT *, CASE WHEN regexp_matches(o, 'エチオピア|ケニア|ルワンダ') THEN 'africa' WHEN regexp_matches(o, 'コロンビア|ブラジル|グアテマラ|パナマ')
    THEN 'latam' WHEN regexp_matches(o, 'インドネシア|インド') THEN 'asia' END AS g, regexp_matches(process, 'Natural|Honey') AS sweet,
    NOT regexp_matches(process, 'Natural|Honey') AND process LIKE '%Washed%' AS washed FROM r),
  e AS (SELECT "user", 'attr' AS kind, g AS name, w * 1.2::DOUBLE AS weight FROM rg WHERE g IS NOT NULL
    UNION ALL SELECT "user", 'attr', 'natural', w FROM rg WHERE sweet UNION ALL SELECT "user", 'attr', 'clean', w * 0.8::DOUBLE FROM rg WHERE washed
    UNION ALL SELECT "user", 'attr', 'experimental', w FROM rg WHERE process LIKE '%Anaerobic%'
    UNION ALL SELECT "user", 'attr', 'geisha', w FROM rg WHERE variety = 'geisha'
    UNION ALL SELECT "user", 'attr', 'domestic', w * 0.6::DOUBLE FROM rg WHERE country = 'JP'
    UNION ALL SELECT "user", 'attr', 'asia', w * 0.5::DOUBLE FROM rg WHERE region IN ('eastAsia', 'seAsiaIndia')
    UNION ALL SELECT "user", 'affinity', shop, w * 0.8::DOUBLE FROM rg WHERE w > 0 AND country IS NOT NULL
    UNION ALL SELECT "user", 'group', g, 1 FROM rg WHERE g IS NOT NULL AND w > 0
    UNION ALL SELECT "user", 'process', 'Natural/Honey', 1 FROM rg WHERE sweet AND w > 0
    UNION ALL SELECT "user", 'process', 'Washed', 1 FROM rg WHERE washed AND w > 0
    UNION ALL SELECT "user", 'family', family, w FROM rg WHERE family IS NOT NULL AND w > 0),
  taste AS (SELECT "user", kind, name, sum(weight) AS weight, count(*) AS n FROM e GROUP BY 1, 2, 3),
  vec AS (SELECT "user", name AS feature, weight / nullif(sqrt(sum(weight * weight) OVER (PARTITION BY "user")), 0) AS weight
    FROM taste WHERE kind = 'attr')"""


def _taste(spark, sf):
    ratings = S.ratings(spark, sf).select("user", "item_id", "shop", "origin", "rating")
    return preference.taste_features(ratings, S.rated_items(spark, sf), S.shops(spark, sf))


@query(with_(S.sql_shops(), SQL_TASTE, body="""SELECT "user", kind, name, round(weight, 6) + 0.0::DOUBLE AS weight, n FROM taste"""))
def taste_evidence(spark, sf):
    return _taste(spark, sf).select("user", "kind", "name", (F.round("weight", 6) + 0.0).alias("weight"), "n")


@query(with_(S.sql_shops(), SQL_TASTE, body="""SELECT "user", feature, round(weight, 6) + 0.0::DOUBLE AS weight FROM vec"""))
def taste_vectors(spark, sf):
    return preference.taste_vector(_taste(spark, sf)).select("user", "feature", (F.round("weight", 6) + 0.0).alias("weight"))


@query(with_(S.sql_shops(), SQL_TASTE, """tops AS (SELECT "user", kind, name FROM taste QUALIFY row_number() OVER
    (PARTITION BY "user", kind ORDER BY round(weight, 9) DESC, name) = 1)""", body="""
  SELECT "user", coalesce(max(name) FILTER (kind = 'group'), '') AS top_group, coalesce(max(name) FILTER (kind = 'process'), '') AS top_process,
    coalesce(max(name) FILTER (kind = 'family'), '') AS top_family FROM tops GROUP BY 1"""))
def taste_tops(spark, sf):
    return preference.favourites_of(_taste(spark, sf)).na.fill("")


@query(with_(S.sql_shops(), SQL_TASTE, SQL_ANSWERS, """b AS (SELECT "user", feature, weight FROM answers
    UNION ALL SELECT "user", feature, weight * 0.35::DOUBLE FROM answers UNION ALL SELECT "user", feature, weight * 3.5::DOUBLE FROM vec)""",
    body="""SELECT "user", feature, round(sum(weight), 6) + 0.0::DOUBLE AS weight FROM b GROUP BY 1, 2"""))
def blended_weights(spark, sf):
    answers = preference.answer_weights(_answers(spark, sf))
    mixed = preference.blend(answers, answers, preference.taste_vector(_taste(spark, sf)))
    return mixed.select("user", "feature", (F.round("weight", 6) + 0.0).alias("weight"))


_DOTS = " UNION ALL ".join(
    f"""SELECT "user", {q} AS question, {o} AS opt, """
    + (" + ".join(f"coalesce(max(weight) FILTER (feature = '{f}'), 0) * {float(w)}::DOUBLE" for f, w in option.items()) or "0")
    + """ AS s FROM vec GROUP BY "user" """
    for q, options in enumerate(rules.QUIZ) for o, option in enumerate(options))


@query(with_(S.sql_shops(), SQL_TASTE, f"dots AS ({_DOTS})", body="""SELECT "user", question, CASE WHEN round(s, 9) > 0.08 THEN opt ELSE -1 END AS option
  FROM dots QUALIFY row_number() OVER (PARTITION BY "user", question ORDER BY round(s, 9) DESC, opt) = 1"""))
def suggested_options(spark, sf):
    return preference.suggested_options(preference.taste_vector(_taste(spark, sf)))


@query("""SELECT user_id AS "user", event_type AS feature, round(list_reduce(list_prepend(0.0::DOUBLE, list((value - 20) / 20 ORDER BY ts)),
  lambda p, v: greatest(-4, least(4, p + v * 0.5))), 6) AS weight FROM events GROUP BY 1, 2""")
def learned_profile(spark, sf):
    runs = S.table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("feature"),
                                               ((F.col("value") - 20) / 20).alias("weight"), "ts")
    return preference.learn(runs, chunk=50).select("user", "feature", F.round("weight", 6).alias("weight"))


SQL_SCORED = """scored AS (SELECT a."user", a.shop, a.s + coalesce(tanh(f.weight / 3), 0) * 1.2::DOUBLE AS score FROM
    (SELECT v."user", z.shop, sum(v.weight * z.z) AS s FROM vec v JOIN z ON v.feature = z.feature GROUP BY 1, 2) a
    LEFT JOIN taste f ON f.kind = 'affinity' AND f."user" = a."user" AND f.name = a.shop),
  best AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, shop) AS place FROM scored QUALIFY place <= 5)"""


def _evidence(spark, sf):
    """Taste vectors, shop profiles, liked shops, and the shops' tallies."""
    taste = settle(_taste(spark, sf))
    profiles, tally = profile.shop_profiles(_stock(spark, sf), S.shops(spark, sf), order="seq")
    liked = taste.filter(F.col("kind") == "affinity").select("user", F.col("name").alias("shop"), "weight")
    return settle(preference.taste_vector(taste)), profiles, liked, tally


def _scored(spark, sf):
    weights, profiles, liked, tally = _evidence(spark, sf)
    ranked = preference.score_shops(weights, profiles, liked, n=5)
    return settle(ranked), weights, profiles, tally


@query(with_(*BASE, SQL_TASTE, SQL_FEATURES, SQL_SCORED, body="""SELECT "user", place, shop, round(score, 5) AS score FROM best"""))
def shop_scores(spark, sf):
    ranked = _scored(spark, sf)[0]
    return ranked.select("user", F.col("place").cast("bigint").alias("place"), "shop", F.round("score", 5).alias("score"))


SQL_JAPAN = SQL_SCORED.replace("FROM vec v JOIN z ON v.feature = z.feature", """FROM vec v JOIN z ON v.feature = z.feature
    WHERE z.shop IN (SELECT shop FROM shops WHERE country = 'JP')""")


@query(with_(*BASE, SQL_TASTE, SQL_FEATURES, SQL_JAPAN, body="""SELECT "user", place, shop, round(score, 5) AS score FROM best"""))
def shop_scores_country(spark, sf):
    """The same among the shops of one country."""
    weights, profiles, liked = _evidence(spark, sf)[:3]
    ranked = preference.score_shops(weights, profiles, liked, n=5, shops=S.shops(spark, sf), country="JP")
    return ranked.select("user", F.col("place").cast("bigint").alias("place"), "shop", F.round("score", 5).alias("score"))


SQL_FROM_LOG = SQL_SCORED.replace("sum(v.weight * z.z)", "6 * sum(v.weight * z.z)").replace("place <= 5", "place <= 3")


@query(with_(*BASE, SQL_TASTE, SQL_FEATURES, SQL_FROM_LOG, body="""SELECT "user", place, shop, round(score, 5) AS score FROM best"""))
def log_only_scores(spark, sf):
    """Three shops for users of whom only the log is known."""
    ranked = preference.recommend_from_log(*_evidence(spark, sf)[:3])
    return ranked.select("user", F.col("place").cast("bigint").alias("place"), "shop", F.round("score", 5).alias("score"))


@query(with_(S.sql_shops(), SQL_TASTE, body="""SELECT "user", shop, round(sum(weight), 6) AS weight FROM (
    SELECT "user", name AS shop, weight FROM taste WHERE kind = 'affinity'
    UNION ALL SELECT c_custkey, 's' || (1 + c_custkey % 7), 3 FROM customer UNION ALL SELECT c_custkey, 's' || (1 + c_custkey % 14), 3 FROM customer) GROUP BY 1, 2"""))
def clicked_affinity(spark, sf):
    """Liking from the log, and two clicks of each customer, on one shop or on two."""
    liked = _taste(spark, sf).filter(F.col("kind") == "affinity").select("user", F.col("name").alias("shop"), "weight")
    key = F.col("c_custkey")
    clicks = S.table(spark, sf, "customer").select(key.alias("user"), F.explode(F.array(key % 7, key % 14)).alias("k"))
    pushed = preference.add_clicks(liked, clicks.select("user", F.concat(F.lit("s"), F.col("k") + 1).alias("shop")))
    return pushed.select("user", "shop", F.round("weight", 6).alias("weight"))


@query(with_(*BASE, SQL_TASTE, SQL_FEATURES, SQL_SCORED, """facts AS (
    SELECT shop, 0 AS p, 'africa' AS feature, 'アフリカ産が在庫の' || CAST(floor(africa / n_origin * 100 + 0.5) AS BIGINT) || '%' AS t FROM trust WHERE n_origin >= 4
    UNION ALL SELECT shop, 1, 'latam', '中南米産が在庫の' || CAST(floor(latam / n_origin * 100 + 0.5) AS BIGINT) || '%' FROM trust WHERE n_origin >= 4
    UNION ALL SELECT shop, 2, 'asia', 'アジア産が在庫の' || CAST(floor(asia / n_origin * 100 + 0.5) AS BIGINT) || '%' FROM trust WHERE n_origin >= 4
    UNION ALL SELECT shop, 3, 'natural', 'Natural・Honey が' || CAST(floor("natural" / n * 100 + 0.5) AS BIGINT) || '%' FROM trust WHERE "natural" > 0
    UNION ALL SELECT shop, 4, 'clean', 'Washed が' || CAST(floor(clean / n * 100 + 0.5) AS BIGINT) || '%' FROM trust WHERE clean > 0
    UNION ALL SELECT shop, 5, 'experimental', 'Anaerobic など' || experimental || '点' FROM trust WHERE experimental > 0
    UNION ALL SELECT shop, 6, 'geisha', 'ゲイシャ・シドラ' || geisha || '点' FROM trust WHERE geisha > 0),
  ranked AS (SELECT b."user", b.shop, t, row_number() OVER (PARTITION BY b."user", b.shop ORDER BY v.weight * z.z DESC, p) AS r
    FROM best b JOIN vec v USING ("user") JOIN z ON z.shop = b.shop AND z.feature = v.feature
    JOIN facts f ON f.shop = b.shop AND f.feature = v.feature WHERE v.weight > 0 AND z.z > 0.2)""", body="""
  SELECT "user", shop, string_agg(t, ' ・ ' ORDER BY r) AS reason FROM ranked WHERE r <= 2 GROUP BY 1, 2"""))
def shop_reasons(spark, sf):
    return profile.reasons(*_scored(spark, sf))


# --- nearest items ----------------------------------------------------------------------------------

SQL_POINTS = f"""pt AS (SELECT vec_id AS id, {S._pick(["エチオピア", "ケニア", "ブレンド", "コロンビア", ""], 'label')} AS origin, 's' || vec_id % 7 AS shop,
    {S._pick(["berry", "tropical", "floral", "citrus", "choco"], 'label + vec_id')} AS family, embedding[1]::DOUBLE * 100 + 50 AS x,
    embedding[2]::DOUBLE * 100 + 50 AS y, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE abs(embedding[3]::DOUBLE) * 20000 + 300 END AS p100 FROM embeddings),
  pair AS (SELECT a.id, b.id AS match, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + CASE WHEN a.family = b.family THEN 0 ELSE 18 END
      + CASE WHEN a.p100 >= 1 AND b.p100 >= 1 THEN least(30, 8 * abs(log2(b.p100 / a.p100))) ELSE 0 END + CASE WHEN a.shop = b.shop THEN 12 ELSE 0 END AS d,
    a.origin = b.origin AS same FROM pt a JOIN pt b ON a.id <> b.id AND b.origin NOT IN ('', 'ブレンド'))"""


@query(with_(SQL_POINTS, body="""SELECT id, match, round(d, 6) AS distance FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, match) = 1"""))
def next_item_same(spark, sf):
    p = S.points(spark, sf)
    return neighbours.nearest_item(p, p, same_origin=True).select("id", "match", F.round("distance", 6).alias("distance"))


@query(with_(SQL_POINTS, body="""SELECT id, match, round(d, 6) AS distance FROM pair WHERE NOT same QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, match) = 1"""))
def next_item_other(spark, sf):
    p = S.points(spark, sf)
    return neighbours.nearest_item(p, p, same_origin=False).select("id", "match", F.round("distance", 6).alias("distance"))


# --- user logs --------------------------------------------------------------------------------------

@query(with_(SQL_LOG, """cur AS (SELECT "user", item_id, "at", rating, shop FROM log WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY "user", item_id ORDER BY "at" DESC) = 1),
  inc AS (SELECT "user", item_id, "at", rating FROM log WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY "user", item_id ORDER BY "at" DESC) = 1)""", body="""
  SELECT coalesce(c."user", i."user") AS "user", coalesce(c.item_id, i.item_id) AS item_id, greatest(c."at", i."at") AS "at",
    coalesce(CASE WHEN c."at" IS NULL OR i."at" >= c."at" THEN i.rating END, c.rating) AS rating, coalesce(c.shop, '') AS shop
  FROM cur c FULL JOIN inc i ON c."user" = i."user" AND c.item_id = i.item_id"""))
def lww_merge(spark, sf):
    log = S.ratings(spark, sf)
    current = log.filter(F.col("event_id") % 2 == 0).select("user", "item_id", "at", "rating", "shop")
    incoming = log.filter(F.col("event_id") % 2 == 1).select("user", "item_id", "at", "rating")
    return userlog.sync(current, incoming).na.fill("", ["shop"])


@query(with_(SQL_LOG, body="""SELECT "user", event_id, "at" FROM log WHERE event_id % 2 = 0 OR event_id % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY "at" DESC, event_id) <= 50"""))
def history_cap(spark, sf):
    log = S.ratings(spark, sf).select("user", "event_id", "at")
    current, incoming = log.filter(F.col("event_id") % 2 == 0), log.filter(F.col("event_id") % 3 == 0)
    return userlog.merge_insert_only(current, incoming, ["user", "event_id"], [F.desc("at"), F.asc("event_id")], cap=50)


@query(with_(SQL_LOG, body="""SELECT "user", item_id, arg_max(rating, "at") AS rating, max("at") AS "at" FROM log GROUP BY 1, 2"""))
def upsert_ratings(spark, sf):
    log = S.ratings(spark, sf).select("user", "item_id", "rating", "at", "event_id")
    old, new = log.filter(F.col("event_id") < 300).drop("event_id"), log.filter(F.col("event_id") >= 300).drop("event_id")
    return userlog.upsert_ratings(old, new)


SQL_WATCH = """watch AS (SELECT "user", item_id, max("at") AS "at" FROM log GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


@query(with_(SQL_LOG, SQL_WATCH, body="""SELECT "user", item_id, "at" FROM watch QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY "at", item_id) <= 3"""))
def watch_list(spark, sf):
    return userlog.watch_list(S.ratings(spark, sf), cap=3)


@query(with_(SQL_LOG, S.sql_shops(), SQL_WATCH, body="""SELECT w."user", w.item_id, w."at", p.shop, p.name FROM watch w JOIN parts p ON p.id = w.item_id
  JOIN shops s ON s.shop = p.shop WHERE p.status = 'now' AND s.url <> ''"""))
def back_in_stock(spark, sf):
    watches = userlog.watch_list(S.ratings(spark, sf))
    return userlog.back_in_stock(watches, S.rated_items(spark, sf), S.shops(spark, sf))


SQL_JOINED = """joined AS (SELECT l."user", l.rating, l.shop, l."at", l.item_id, coalesce(nullif(l.origin, ''), p.origin, '') AS origin,
  p.id IS NOT NULL AS matched, p.process, p.yen FROM log l LEFT JOIN parts p ON p.id = l.item_id)"""


def _joined(spark, sf):
    log = S.ratings(spark, sf).select("user", "item_id", "rating", "shop", "origin", "at")
    return userlog.with_items(log, S.rated_items(spark, sf))


@query(with_(SQL_LOG, S.sql_shops(), SQL_JOINED, body="""SELECT j."user", count(*) AS n, count(*) FILTER (rating <> 0) AS n_rated,
  count(DISTINCT s.shop) AS n_shops, count(DISTINCT nullif(origin, '')) AS n_origins, round(sum(yen), 4) AS spend,
  count(*) FILTER (matched) AS n_priced, round(coalesce(avg(rating) FILTER (rating <> 0), 0), 8) AS mean_rating
  FROM joined j LEFT JOIN shops s ON s.shop = j.shop GROUP BY 1"""))
def portfolio(spark, sf):
    p = userlog.portfolio(_joined(spark, sf), S.shops(spark, sf))
    return p.select("user", "n", "n_rated", "n_shops", "n_origins", F.round("spend", 4).alias("spend"), "n_priced",
                    F.round("mean_rating", 8).alias("mean_rating"))


SQL_FACETS = """facets AS (SELECT "user", 'origin' AS facet, origin AS value FROM joined WHERE origin <> ''
  UNION ALL SELECT "user", 'group', CASE WHEN regexp_matches(origin, 'エチオピア|ケニア|ルワンダ') THEN 'africa' WHEN regexp_matches(origin,
    'コロンビア|ブラジル|グアテマラ|パナマ') THEN 'latam' ELSE 'asia' END FROM joined WHERE origin NOT IN ('', 'ブレンド', '台湾')
  UNION ALL SELECT "user", 'process', CASE process WHEN 'Washed' THEN 'washed' WHEN 'Natural' THEN 'natural' WHEN 'Honey' THEN 'honey'
    WHEN 'Anaerobic Washed' THEN 'awashed' WHEN 'Anaerobic Natural' THEN 'anatural' WHEN 'Anaerobic' THEN 'anatural' ELSE 'other' END FROM joined WHERE matched
  UNION ALL SELECT "user", 'stars', CAST(rating AS VARCHAR) FROM joined WHERE rating <> 0
  UNION ALL SELECT "user", 'shop', shop FROM joined),
  facet_counts AS (SELECT "user", facet, value, count(*) AS n FROM facets GROUP BY 1, 2, 3)"""


@query(with_(SQL_LOG, SQL_JOINED, SQL_FACETS, body="""SELECT * FROM facet_counts"""))
def log_breakdown(spark, sf):
    return userlog.breakdown(_joined(spark, sf))


@query(with_(SQL_LOG, SQL_JOINED, SQL_FACETS, body="""SELECT "user", value, n, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, value) AS place
  FROM facet_counts WHERE facet = 'origin' QUALIFY place <= 8"""))
def top_origins(spark, sf):
    top = userlog.top_values(userlog.breakdown(_joined(spark, sf)), "origin", 8)
    return top.select("user", "value", "n", F.col("place").cast("bigint").alias("place"))


@query(with_(SQL_LOG, body="""SELECT "user", event_id, rating, row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, "at" DESC, item_id) AS place
  FROM log WHERE rating >= 4 QUALIFY place <= 5"""))
def favourites(spark, sf):
    best = userlog.favourites(S.ratings(spark, sf))
    return best.select("user", "event_id", "rating", F.col("place").cast("bigint").alias("place"))


@query("""WITH days AS (SELECT unnest(generate_series(DATE '2024-02-03' - 125, DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day),
  users AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT u.user_id AS "user", CAST(d.day AS VARCHAR) AS day, coalesce(c.n, 0) AS n, d.day > DATE '2024-01-30' AS future
  FROM users u CROSS JOIN days d LEFT JOIN c ON c.user_id = u.user_id AND c.day = d.day""")
def activity_calendar(spark, sf):
    log = S.ratings(spark, sf)
    days = userlog.activity_calendar(log, "ts", F.lit("2024-01-30"), group=["user"])
    return days.withColumn("day", F.col("day").cast("string"))


# --- billing ----------------------------------------------------------------------------------------

_TYPES = [billing.CHECKOUT, billing.UPDATED, billing.PAID, billing.DELETED, billing.UPDATED, billing.PAID]


def billing_events(spark, sf):
    """Orders as billing events of customers; each customer is a user, deliveries repeat."""
    o, key = S.table(spark, sf, "orders"), F.col("o_orderkey")
    kind = S.choose(_TYPES, key)
    events = o.select(
        F.concat(F.lit("e"), key).alias("event_id"), kind.alias("type"), F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)").alias("ts"),
        F.when((kind == billing.CHECKOUT) & (key % 5 != 0), F.concat(F.lit("u"), "o_custkey")).alias("user_id"),
        F.concat(F.lit("c"), "o_custkey").alias("customer_id"),
        F.when(key % 7 != 0, F.concat(F.lit("sub"), "o_custkey")).alias("subscription_id"),
        S.choose(["active", "past_due", "trialing"], key).alias("status"), F.lit(None).cast("string").alias("price_id"),
        F.when(key % 4 == 0, "year").otherwise("month").alias("interval"),
        F.expr("o_orderdate + INTERVAL 30 DAYS").alias("current_period_end"),
    )
    repeated = events.filter(F.substring("event_id", 2, 20).cast("bigint") % 3 == 0)
    return events.unionByName(repeated)


SQL_BILLING = f"""ev AS (SELECT 'e' || o_orderkey AS event_id, {S._pick(_TYPES, 'o_orderkey')} AS type,
    o_orderdate + to_seconds(o_orderkey % 86400) AS ts, o_orderkey % 5 <> 0 AS named, o_custkey, o_orderkey % 7 <> 0 AS sub,
    {S._pick(["active", "past_due", "trialing"], 'o_orderkey')} AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'premium_yearly' ELSE 'premium_monthly' END AS plan,
    o_orderdate + INTERVAL 30 DAY AS current_period_end FROM orders),
  first_co AS (SELECT o_custkey, min(ts) AS f FROM ev WHERE type = '{billing.CHECKOUT}' AND named GROUP BY 1),
  used AS (SELECT e.* FROM ev e JOIN first_co USING (o_custkey) WHERE (type = '{billing.CHECKOUT}' AND named) OR (type <> '{billing.CHECKOUT}' AND ts >= f)),
  ch AS (SELECT o_custkey, ts, event_id, CASE WHEN type = '{billing.CHECKOUT}' AND NOT sub THEN 'premium_monthly' WHEN type = '{billing.DELETED}' THEN 'free' ELSE plan END AS plan,
    CASE WHEN type = '{billing.CHECKOUT}' AND NOT sub THEN 'active' WHEN type = '{billing.DELETED}' THEN 'canceled' ELSE status END AS status,
    CASE WHEN type = '{billing.CHECKOUT}' AND NOT sub THEN NULL ELSE current_period_end END AS pe,
    CASE WHEN sub AND type <> '{billing.PAID}' THEN 'sub' || o_custkey END AS sid FROM used WHERE NOT (type = '{billing.PAID}' AND NOT sub)),
  ent AS (SELECT 'u' || o_custkey AS user_id, arg_max(plan, (ts, event_id)) AS plan, arg_max(status, (ts, event_id)) AS status,
    arg_max(pe, (ts, event_id)) FILTER (pe IS NOT NULL) AS current_period_end, 'c' || o_custkey AS customer_id,
    coalesce(arg_max(sid, (ts, event_id)) FILTER (sid IS NOT NULL), '') AS subscription_id, max(ts) AS updated_at FROM ch GROUP BY o_custkey)"""


@query(with_(SQL_BILLING, body="SELECT * FROM ent"))
def entitlements(spark, sf):
    return billing.fold_entitlements(billing_events(spark, sf)).na.fill("", ["subscription_id"])


@query(with_(SQL_BILLING, body="""SELECT user_id, starts_with(plan, 'premium') AND status IN ('active', 'trialing')
  AND (current_period_end IS NULL OR TIMESTAMP '2000-01-01' <= current_period_end) AS paid FROM ent"""))
def paid_users(spark, sf):
    rows = billing.fold_entitlements(billing_events(spark, sf))
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    return rows.select("user_id", plan_is_paid(F.col("plan"), F.col("status"), F.col("current_period_end"), now).alias("paid"))
