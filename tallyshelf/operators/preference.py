"""Preferences of users: taste vectors from ratings, blending, learning, and scoring shops."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyshelf.functions import rules
from tallyshelf.functions.classify import origin_group
from tallyshelf.operators.pick import top_per_group
from tallyshelf.operators.profile import FEATURES
from tallyshelf.session import settle

# Strength of the parts of a blend, cap and rate of learning.
PAST_WEIGHT, LOG_WEIGHT = 0.35, 3.5
LEARN_CAP, LEARN_RATE = 4.0, 0.5
CLICK_AFFINITY = 3.0


def rating_weight(rating: Column) -> Column:
    """High ratings pull, low ratings push; null where a rating says nothing."""
    weight = (rating - 2.5) * 0.8
    return F.when((F.coalesce(rating, F.lit(0)) != 0) & (F.abs(weight) >= 0.01), weight)


def _rated(ratings: DataFrame, items: DataFrame, shops: DataFrame, profiles: DataFrame | None) -> DataFrame:
    item = items.select(
        F.col("id").alias("item_id"), F.col("origin").alias("item_origin"), "process", "variety",
        *([F.col("family")] if "family" in items.columns else [F.lit(None).cast("string").alias("family")]),
    )
    dim = shops.select("shop", "country", "region")
    if profiles is not None:
        roast = profiles.filter(F.col("feature").isin("light", "medium")).groupBy("shop").agg(
            F.max(F.when(F.col("feature") == "light", F.col("z"))).alias("light"),
            F.max(F.when(F.col("feature") == "medium", F.col("z"))).alias("medium"),
        )
        dim = dim.join(roast, "shop", "left")
    else:
        dim = dim.withColumn("light", F.lit(None).cast("double")).withColumn("medium", F.lit(None).cast("double"))
    return (
        ratings.withColumn("w", rating_weight(F.col("rating"))).filter(F.col("w").isNotNull())
        .join(item, "item_id", "left").join(dim, "shop", "left")
        .withColumn("origin", F.coalesce(F.nullif("origin", F.lit("")), F.col("item_origin"), F.lit("")))
    )


def taste_features(ratings: DataFrame, items: DataFrame, shops: DataFrame,
                   profiles: DataFrame | None = None) -> DataFrame:
    """Summed evidence (user, kind, name, weight, n): kinds attr, affinity, group, process, family.

    ``ratings`` has user, item_id, shop, origin, rating. One pass: every rating becomes a short
    list of entries that are summed before the shuffle.
    """
    w, liked = F.col("w"), F.col("w") > 0
    # Each pattern runs once per rating, ahead of the entries that use it.
    process, sweet, group = F.coalesce("process", F.lit("")), F.col("_sweet"), F.col("_group")
    washed = ~sweet & F.col("_washed")
    rated = _rated(ratings, items, shops, profiles).select(
        "*", origin_group(F.col("origin")).alias("_group"),
        *[process.rlike("(?i)" + p).alias(name) for name, p in (("_sweet", "Natural|Honey"), ("_washed", "Washed"), ("_trial", "Anaerobic"))])

    def entry(kind: str, test: Column, name: Column, weight: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("kind"), name.alias("name"), weight.cast("double").alias("weight")))

    def attr(test: Column, name: str, weight: Column) -> Column:
        return entry("attr", test, F.lit(name), weight)

    light = F.coalesce(F.col("light") > 0.7, F.lit(False))
    medium = ~light & F.coalesce(F.col("medium") > 0.7, F.lit(False))
    known_shop = F.col("country").isNotNull()
    # How much each trait of a rated item counts.
    entries = F.array(
        entry("attr", group.isNotNull(), group, w * 1.2),
        attr(sweet, "natural", w),
        attr(washed, "clean", w * 0.8),
        attr(F.col("_trial"), "experimental", w),
        attr(F.col("variety").isin("geisha", "sidra"), "geisha", w),
        attr(F.col("country") == "JP", "domestic", w * 0.6),
        attr(F.col("region").isin("eastAsia", "seAsiaIndia"), "asia", w * 0.5),
        attr(light, "light", w * 0.6),
        attr(medium, "medium", w * 0.5),
        entry("affinity", known_shop & liked, F.col("shop").cast("string"), w * 0.8),
        entry("group", group.isNotNull() & liked, group, F.lit(1.0)),
        entry("process", sweet & liked, F.lit("Natural/Honey"), F.lit(1.0)),
        entry("process", washed & liked, F.lit("Washed"), F.lit(1.0)),
        entry("family", F.col("family").isNotNull() & liked, F.col("family"), w),
    )
    # Entries that do not apply are dropped as rows: a lambda that filters the array would be interpreted, and the entries with it.
    rows = rated.select("user", F.inline(entries)).filter(F.col("kind").isNotNull())
    return rows.groupBy("user", "kind", "name").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def unit_length(weights: DataFrame, user: str = "user") -> DataFrame:
    """Scale each user's vector to length 1; a zero vector stays as it is."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(user)))
    return weights.withColumn("_len", length).withColumn(
        "weight", F.when(F.col("_len") == 0, F.col("weight")).otherwise(F.col("weight") / F.col("_len"))
    ).drop("_len")


def taste_vector(features: DataFrame) -> DataFrame:
    """Unit vector (user, feature, weight) of the attr evidence."""
    attr = features.filter(F.col("kind") == "attr").select("user", F.col("name").alias("feature"), "weight")
    return unit_length(attr)


def favourites_of(features: DataFrame) -> DataFrame:
    """Most liked origin group, process and flavour family per user; ties by name."""
    def top(kind: str) -> Column:
        chosen = F.col("kind") == kind
        # The least (-weight, name) is the heaviest entry, the first name on a tie. Rounding makes
        # equal sums equal whatever the order they were added in.
        weight = F.round(-F.col("weight"), 9).alias("w")
        return F.min(F.when(chosen, F.struct(weight, F.col("name").alias("name"))))["name"]

    return features.groupBy("user").agg(
        top("group").alias("top_group"), top("process").alias("top_process"), top("family").alias("top_family")
    )


def answer_weights(answers: DataFrame) -> DataFrame:
    """(user, feature, weight) summed over the chosen quiz options; answers have question, option."""
    options = F.array(*[
        F.struct(F.lit(q).alias("question"), F.lit(o).alias("option"), F.lit(f).alias("feature"),
                 F.lit(float(w)).alias("weight"))
        for q, question in enumerate(rules.QUIZ) for o, option in enumerate(question) for f, w in option.items()
    ])
    chosen = F.filter(options, lambda e: (e["question"] == F.col("_q")) & (e["option"] == F.col("_o")))
    return (
        answers.select("user", F.col("question").alias("_q"), F.col("option").alias("_o"))
        .select("user", F.inline(chosen))
        .groupBy("user", "feature").agg(F.sum("weight").alias("weight"))
    )


def blend(answers: DataFrame, past: DataFrame, log: DataFrame) -> DataFrame:
    """Today's answers plus a share of the learned profile and of the log's unit vector."""
    parts = (
        answers.select("user", "feature", "weight")
        .unionByName(past.select("user", "feature", (F.col("weight") * PAST_WEIGHT).alias("weight")))
        .unionByName(log.select("user", "feature", (F.col("weight") * LOG_WEIGHT).alias("weight")))
    )
    return parts.groupBy("user", "feature").agg(F.sum("weight").alias("weight"))


def quiz_type(answers: DataFrame) -> DataFrame:
    """Strongest feature of the answers per user, ``medium`` where no answer weighs; ties by name."""
    best = F.min(F.when(F.col("weight").isNotNull(), F.struct((-F.col("weight")).alias("w"), "feature")))["feature"]
    return answers.groupBy("user").agg(F.coalesce(best, F.lit("medium")).alias("type"))


def _compose(steps: Column) -> Column:
    """Fold ordered steps (add, low, high) into one step of the same form.

    Adding and clamping, done one after the other, is again one addition and one clamp, so long
    runs can be folded in pieces and the pieces joined in order.
    """
    def clamp(x: Column, s: Column) -> Column:
        return F.least(F.greatest(x, s["low"]), s["high"])

    start = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    return F.aggregate(steps, start, lambda acc, s: F.struct(
        (acc["add"] + s["add"]).alias("add"),
        clamp(acc["low"] + s["add"], s).alias("low"),
        clamp(acc["high"] + s["add"], s).alias("high"),
    ))


def learn(runs: DataFrame, cap: float = LEARN_CAP, rate: float = LEARN_RATE, chunk: int = 1000,
          slice_hours: float = 24) -> DataFrame:
    """Learned profile (user, feature, weight): ``clamp(previous + rate * weight)`` run by run.

    ``runs`` has user, feature, weight, ts. The order matters, yet no user is gathered whole: runs
    are folded per chunk of at most ``chunk`` rows of a time slice, then per slice, then per user.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    keys = ["user", "feature"]
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("ts")
    steps = (
        runs.withColumn("_slice", F.floor(seconds / (slice_hours * 3600)))
        .withColumn("_chunk", F.floor((F.row_number().over(in_slice) - 1) / chunk))
        .select(*keys, "_slice", "_chunk", F.col("ts").alias("_at"),
                F.struct((F.col("weight") * rate).alias("add"), F.lit(-cap).alias("low"), F.lit(cap).alias("high"))
                .alias("_step"))
    )

    def fold(df: DataFrame, group: list[str], order: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_step").alias("step"))))
        return df.groupBy(*group).agg(_compose(F.transform(ordered, lambda s: s["step"])).alias("_step"))

    chunks = fold(steps, [*keys, "_slice", "_chunk"], "_at")
    slices = fold(chunks, [*keys, "_slice"], "_chunk")
    whole = fold(slices, keys, "_slice")
    from_zero = F.least(F.greatest(F.col("_step.add"), F.col("_step.low")), F.col("_step.high"))
    return whole.select(*keys, from_zero.alias("weight"))


def suggested_options(vectors: DataFrame, threshold: float = 0.08) -> DataFrame:
    """Quiz option closest to a user's unit vector per question, -1 if none exceeds ``threshold``."""
    packed = vectors.groupBy("user").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("_v")
    )

    def dot(option: dict[str, float]) -> Column:
        total = sum((F.coalesce(F.try_element_at(F.col("_v"), F.lit(f)), F.lit(0.0)) * float(w)
                     for f, w in option.items()), F.lit(0.0))
        return F.round(total, 9)  # equal options stay equal, whatever the order of the sums

    def best(question: list[dict[str, float]]) -> Column:
        scores = F.array(*[dot(option) for option in question])
        top = F.array_max(scores)
        return F.when(top > threshold, F.array_position(scores, top).cast("int") - 1).otherwise(-1)

    rows = F.array(*[F.struct(F.lit(q).alias("question"), best(question).alias("option"))
                     for q, question in enumerate(rules.QUIZ)])
    return packed.select("user", F.inline(rows))


def add_clicks(affinity: DataFrame, clicks: DataFrame) -> DataFrame:
    """Affinity (user, shop, weight) after clicks; a click is a strong sign of liking."""
    pushed = clicks.select("user", "shop", F.lit(CLICK_AFFINITY).alias("weight"))
    return affinity.select("user", "shop", "weight").unionByName(pushed).groupBy("user", "shop").agg(
        F.sum("weight").alias("weight")
    )


def _aligned(df: DataFrame, key: str, value: str, features: Sequence[str]) -> DataFrame:
    """One row per key with its feature values as an array in the order of ``features``."""
    cells = [F.coalesce(F.max(F.when(F.col("feature") == f, F.col(value))), F.lit(0.0)) for f in features]
    return df.groupBy(key).agg(F.array(*cells).alias(value))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return np.array(column.combine_chunks().flatten(), np.float64).reshape(-1, width)


def _packed_shops(aligned: DataFrame, width: int, per_block: int, parts: int) -> DataFrame:
    """Blocks of shops with similar z-values: (_block, _shops, _z), the values row by row.

    Shops are ordered by their values' two leading bits, interleaved, so neighbours are alike in all features.
    """
    level = [F.least(F.greatest(F.floor(F.get("z", F.lit(i))) + 2, F.lit(0)), F.lit(3)).cast("bigint") for i in range(width)]
    bits = [F.shiftright(v, 1) for v in level] + [v.bitwiseAND(F.lit(1)) for v in level]
    place = sum((F.shiftleft(b, len(bits) - 1 - i) for i, b in enumerate(bits)), F.lit(0).cast("bigint"))
    schema = pa.schema([("_block", pa.int64()), ("_shops", pa.list_(pa.string())), ("_z", pa.list_(pa.float64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, values = TaskContext.get().partitionId() << 32, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([names], schema.field(1).type), pa.array([values], schema.field(2).type)],
                                              schema=schema)

        for batch in batches:
            for shop, z in zip(batch.column("shop").to_pylist(), batch.column("z").to_pylist()):
                names.append(shop)
                values += z
                if len(names) == per_block:
                    yield out()
                    block, names, values = block + 1, [], []
        if names:
            yield out()

    rows = aligned.select(F.col("shop").cast("string").alias("shop"), "z", place.alias("_place"))
    return rows.repartitionByRange(parts, "_place", "shop").sortWithinPartitions("_place", "shop").select("shop", "z").mapInArrow(
        pack, "_block bigint, _shops array<string>, _z array<double>")


def _first_of(rows: np.ndarray, score: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs are among the first ``n`` of their row by score descending, place ascending; sorted so."""
    order = np.lexsort((place, -score, rows))
    start = np.flatnonzero(np.diff(rows[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return order[nth < n]


def _best_of_slab(n: int, width: int, schema: pa.Schema, chunk: int = 512, tile: int = 1024):
    """The best ``n`` shops of a slab for each user of a share.

    A block's bound for a user is the largest value its box of z-values allows. Blocks are visited in order of
    their bounds, about ``tile`` shops at once; a user skips a tile whose bounds are below its n-th best score so far. A matrix
    product in single precision tells, but for its rounding, which shops of a tile reach that score; these few are
    summed up again, feature by feature, so that equal shops have equal scores.
    """
    run_of = 64  # shops whose largest product is looked at before each
    def run(users: pa.Table, blocks: pa.Table) -> pa.Table:
        if not users.num_rows or not blocks.num_rows:
            return schema.empty_table()
        # In the order of names within a block and over all of them, so that ties can be settled by place.
        sizes = pc.list_value_length(blocks["_shops"]).to_numpy()
        names = np.array(blocks["_shops"].combine_chunks().flatten().to_pylist())
        z = _matrix(blocks["_z"], width)
        by_rank = np.argsort(names, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[by_rank] = np.arange(len(names))
        by_rank = names[by_rank]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        low, high = (f.reduceat(z, starts[:-1], axis=0).T for f in (np.minimum, np.maximum))
        reach = np.abs(z).max(axis=0)
        z_single = z.astype(np.float32)
        at_once = max(1, tile // max(sizes))
        room = np.empty(chunk * -(-at_once * max(sizes) // run_of) * run_of, np.float32)
        weights = _matrix(users["weight"], width)
        out = {"user": [], "shop": [], "score": [], "visited": []}
        for at in range(0, len(weights), chunk):
            w = weights[at:at + chunk]
            w_single = w.astype(np.float32)
            # More than the sums can differ by rounding.
            slack = 4 * (width + 4) * 2.0 ** -24 * (np.abs(w) @ reach) + 1e-36
            bound = np.maximum(w, 0) @ high + np.minimum(w, 0) @ low + slack[:, None]
            best = np.full((len(w), n), -np.inf)
            place = np.full((len(w), n), len(names), np.int64)
            visited = np.zeros(len(w), np.int64)
            ordered = np.argsort(-bound.max(axis=0), kind="stable")
            for first in range(0, len(ordered), at_once):
                ks = ordered[first:first + at_once]
                rows = np.flatnonzero(bound[:, ks].max(axis=1) >= best[:, -1])
                if not len(rows):
                    continue
                visited[rows] += len(ks)
                at_shop = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in ks])
                runs = -(-len(at_shop) // run_of)
                about = room[:len(rows) * runs * run_of].reshape(len(rows), -1)
                np.matmul(w_single[rows], z_single[at_shop].T, out=about[:, :len(at_shop)])
                about[:, len(at_shop):] = -np.inf
                least = best[rows, -1]
                if np.isneginf(least).any() and len(at_shop) >= n:
                    # n shops of this tile reach its n-th best, so nothing below that is wanted.
                    nth = about.shape[1] - n
                    least = np.maximum(least, np.partition(about, nth, axis=1)[:, nth] - slack[rows])
                least = (least - slack[rows]).astype(np.float32)
                # Not "at least": a product beyond single precision is tried.
                about = about.reshape(len(rows), runs, run_of)
                r, run_at = np.nonzero(~(about.max(axis=2) < least[:, None]))
                found_at, c = np.nonzero(~(about[r, run_at] < least[r, None]))
                r, c = r[found_at], run_at[found_at] * run_of + c
                r, c = r[c < len(at_shop)], c[c < len(at_shop)]
                if not len(r):
                    continue
                hit, shop = rows[r], at_shop[c]
                score = np.zeros(len(hit))
                for i in range(width):
                    score += w[hit, i] * z[shop, i]
                held = np.unique(hit)
                hit = np.concatenate([np.repeat(held, n), hit])
                score = np.concatenate([best[held].ravel(), score])
                where = np.concatenate([place[held].ravel(), rank[shop]])
                kept = _first_of(hit, score, where, n)
                # A user of a hit has n entries already, if only unset ones.
                best[held], place[held] = score[kept].reshape(-1, n), where[kept].reshape(-1, n)
            found = place < len(names)
            users_at = np.repeat(np.arange(at, at + len(w)), found.sum(axis=1))
            out["user"].append(users["user"].take(pa.array(users_at)))
            out["shop"].append(pa.array(by_rank[place[found]].tolist(), pa.string()))
            out["score"].append(pa.array(best[found]))
            out["visited"].append(pa.array(visited[users_at - at]))
        columns = [pa.chunked_array([c for x in out["user"] for c in x.chunks], schema.field(0).type),
                   *(pa.chunked_array(out[c], schema.field(c).type) for c in ("shop", "score", "visited"))]
        return pa.table([*columns, pa.array([len(sizes)] * len(columns[0]), pa.int64())], schema=schema)

    return run


def score_shops(weights: DataFrame, profiles: DataFrame, affinity: DataFrame | None = None, *, n: int = 5,
                shops: DataFrame | None = None, country: str | None = None, scale: float = 1.0,
                affinity_weight: float = 1.2, features: Sequence[str] = FEATURES, per_block: int = 64,
                per_slab: int = 100_000, per_share: int = 20_000, counts: bool = False) -> DataFrame:
    """Best ``n`` shops per user: (user, place, shop, score); with ``counts`` also the blocks and those visited.

    The score is the weighted sum of z-scores plus a bounded bonus for liked shops, ties by shop. Similar shops are
    packed into blocks, and a user skips blocks that cannot hold one of its best (exactly: by a bound on the
    sum). A task has the blocks of one slab of ``per_slab`` shops and one share of ``per_share`` users; no row
    is made per pair. Affinity weights are not negative, so the bonus only lifts: liked pairs, which are
    few, are scored by a join and compete with each user's best by the sum alone.
    """
    spark = weights.sparkSession
    if country is not None:
        home = shops.filter(F.col("country") == country).select("shop")
        profiles = profiles.join(home, "shop", "left_semi")
    kinds = {"user": weights.schema["user"].dataType, "shop": profiles.schema["shop"].dataType}
    width = len(features)
    profiles = settle(_aligned(profiles, "shop", "z", features))
    users = _aligned(weights, "user", "weight", features)
    if affinity is not None:
        affinity = settle(affinity.filter("weight > 0").groupBy("user", "shop").agg(F.sum("weight").alias("liking")))
        users = users.join(affinity.select(F.col("user").cast(kinds["user"]).alias("user")).distinct(), "user", "full_outer")
    users = settle(users.select("user", F.transform(F.coalesce("weight", F.array_repeat(F.lit(0.0), width)), lambda w: w * scale).alias("weight")))
    n_shops, n_users, cores = profiles.count(), users.count(), spark.sparkContext.defaultParallelism
    n_slabs, n_shares = max(1, -(-n_shops // per_slab)), max(1, -(-n_users // per_share))
    # Scoring is bound by computation, and shares meet in tasks by hash, so there are more of them than tasks that can run.
    n_shares = max(n_shares, min(3 * cores, -(-n_users // 1000)))
    parts = max(1, min(cores, n_shops // (16 * per_block)))
    blocks = _packed_shops(profiles, width, per_block, parts).withColumn("_slab", F.pmod(F.xxhash64("_block"), F.lit(n_slabs)).cast("int")).withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.lit(n_shares - 1))))
    shared = users.withColumn("_share", F.pmod(F.xxhash64("user"), F.lit(n_shares)).cast("int")).withColumn(
        "_slab", F.explode(F.sequence(F.lit(0), F.lit(n_slabs - 1))))
    schema = f"user {kinds['user'].simpleString()}, shop string, score double, visited bigint, blocks bigint"
    arrow = pa.schema([("user", to_arrow_type(kinds["user"])), ("shop", pa.string()), ("score", pa.float64()), ("visited", pa.int64()),
                       ("blocks", pa.int64())])
    tasks = n_slabs * n_shares
    found = shared.repartition(tasks, "_slab", "_share").groupBy("_slab", "_share").cogroup(
        blocks.repartition(tasks, "_slab", "_share").groupBy("_slab", "_share")).applyInArrow(_best_of_slab(n, width, arrow), schema)
    if counts:
        found = settle(found)
        seen = found.groupBy("user").agg(F.max("visited").alias("visited"), F.max("blocks").alias("blocks"))
    rows = found.select("user", "shop", "score")
    if affinity is not None:
        dot = sum((F.get("weight", F.lit(i)) * F.get("z", F.lit(i)) for i in range(width)), F.lit(0.0))
        bonus = F.tanh(F.col("liking") / 3) * affinity_weight
        liked = affinity.join(profiles, "shop").join(users, "user").select(
            "user", F.col("shop").cast("string").alias("shop"), (dot + bonus).alias("score"))
        # A liked pair is in both; the bonus is never negative, so its own score is the larger one.
        rows = rows.unionByName(liked).groupBy("user", "shop").agg(F.max("score").alias("score"))
    best = top_per_group(rows, ["user"], [F.desc("score"), F.asc("shop")], n, rank="place")
    best = best.select("user", "place", F.col("shop").cast(kinds["shop"]).alias("shop"), "score")
    return best.join(seen, "user") if counts else best


def recommend_from_log(vectors: DataFrame, profiles: DataFrame, affinity: DataFrame, n: int = 3, **options) -> DataFrame:
    """Shops for users known only by their log; the unit vector is stretched to an answer's strength."""
    return score_shops(vectors, profiles, affinity, n=n, scale=6.0, **options)
