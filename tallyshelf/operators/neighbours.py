"""Exact nearest item under a distance with bounded penalties.

``distance = hypot(dx, dy) + 18 [other family] + min(30, 8 |log2 price ratio|) + 12 [same shop]``;
the least distance wins, the least id on a tie.

Candidates are summarised in a tree of cells over x, y and log price (4 parts per axis and level,
families apart). Summaries hold tight bounds, so the least possible distance to a cell is known.
A search then takes three steps, all of them equi-joins on cells:

1. a candidate from the item's own cells bounds its best distance from above;
2. cells are opened level by level, keeping only those that could still hold something as near;
3. items meet the candidates of the cells that are left.

Nothing is paired within a group as a whole, and nothing is cut off: a cell is only left out when
its lower bound exceeds a distance already found. Items on one and the same point are reduced to
the three that can be an answer for anyone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions import rules

FAMILY_PENALTY, SHOP_PENALTY, PRICE_CAP, PRICE_SLOPE = 18.0, 12.0, 30.0, 8.0
_PARTS = 4
_PLANE = 100.0  # coordinates are 0 to 100; points outside land in border cells
_LOG_PRICE = 170.0  # 8 * log2 of any price below 2**21
_TOP_LEVELS = 2  # levels with so few cells that many items meet in one
_SHARES = 16
_EPS = 1e-9
_ANY_PRICE = -2  # layer of the samples of all prices; -1 is that of unpriced candidates


def item_distance(a: str, b: str) -> Column:
    """Distance between the items of two struct or alias prefixes."""
    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    ratio = F.abs(F.log2(col(b, "p100") / col(a, "p100"))) * PRICE_SLOPE
    priced = (col(a, "p100") >= 1) & (col(b, "p100") >= 1)
    gap = F.when(priced, F.least(ratio, F.lit(PRICE_CAP))).otherwise(0.0)
    family = F.when(col(a, "family") == col(b, "family"), 0.0).otherwise(FAMILY_PENALTY)
    shop = F.when(col(a, "shop") == col(b, "shop"), SHOP_PENALTY).otherwise(0.0)
    return F.hypot(col(a, "x") - col(b, "x"), col(a, "y") - col(b, "y")) + family + gap + shop


def _located(items: DataFrame, levels: int) -> DataFrame:
    """Add z and the finest cell (cx, cy, cz); unpriced items have a cell layer of their own."""
    parts = _PARTS**levels

    def cell(value: Column, width: float) -> Column:
        inside = F.floor(value / width * parts)
        return F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside)).cast("int")

    z = F.when(F.col("p100") >= 1, F.log2("p100") * PRICE_SLOPE)
    return (
        items.withColumn("z", z)
        .withColumn("cx", cell(F.col("x"), _PLANE)).withColumn("cy", cell(F.col("y"), _PLANE))
        .withColumn("cz", F.when(F.col("z").isNull(), -1).otherwise(cell(F.col("z"), _LOG_PRICE)))
    )


def _reduce_same_point(candidates: DataFrame) -> DataFrame:
    """Candidates that can be the answer for some item among those with equal coordinates.

    Those are the two least ids of the shop with the least id, and the least id of any other shop.
    Ranks are limited inside each task before the shuffle.
    """
    point = ["origin", "x", "y", "family", "p100"]
    per_shop = Window.partitionBy(*point, "shop").orderBy("id")
    kept = candidates.withColumn("_r", F.row_number().over(per_shop)).filter(F.col("_r") <= 2)
    kept = kept.withColumn("_first", F.min("id").over(Window.partitionBy(*point, "shop")))
    per_point = Window.partitionBy(*point).orderBy("_first")
    kept = kept.withColumn("_s", F.dense_rank().over(per_point)).filter(F.col("_s") <= 2)
    return kept.filter((F.col("_s") == 1) | (F.col("_r") == 1)).drop("_r", "_first", "_s")


def _summaries(points: DataFrame, levels: int, group: list[str]) -> list[DataFrame]:
    """Cell summaries per level, finest last; coarser levels are built from finer ones."""
    # Origin leads the sample, so a cell with several origins has samples of two of them.
    sample = F.struct("origin", "id", "x", "y", "family", "shop", "p100")
    base = [F.min(c).alias(f"{c}_min") for c in ("x", "y", "z", "shop", "origin")]
    base += [F.max(c).alias(f"{c}_max") for c in ("x", "y", "z", "shop", "origin")]
    base += [F.min(sample).alias("sample_min"), F.max(sample).alias("sample_max")]
    names = [f"{c}_{e}" for e in ("min", "max") for c in ("x", "y", "z", "shop", "origin", "sample")]
    merge = [(F.min if n.endswith("_min") else F.max)(n).alias(n) for n in names]
    finest = points.groupBy(*group, "family", "cx", "cy", "cz").agg(*base)
    out = [finest]
    for _ in range(levels):
        up = [F.floor(F.col(c) / _PARTS).cast("int").alias(c) for c in ("cx", "cy", "cz")]
        finer = out[0]
        kept = [c for c in finer.columns if c not in ("cx", "cy", "cz")]
        out.insert(0, finer.select(*kept, *up).groupBy(*group, "family", "cx", "cy", "cz").agg(*merge))
    return out


def _shares(level: int) -> int:
    return _SHARES if level <= _TOP_LEVELS else 1


def _spread_cells(cells: DataFrame, level: int) -> DataFrame:
    """Copy the few cells of the top levels, so that the items meeting there can be divided."""
    return cells.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(_shares(level) - 1))))


def _share_of(item: str, level: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(_shares(level))).cast("int")


def _least_distance(q: str = "q") -> Column:
    """Lower bound of the distance from item ``q`` to anything in the joined cell summary."""
    def gap(axis: str) -> Column:
        value = F.col(f"{q}.{axis}")
        return F.greatest(F.col(f"{axis}_min") - value, value - F.col(f"{axis}_max"), F.lit(0.0))

    z = F.when(F.col(f"{q}.z").isNull() | F.col("z_min").isNull(), 0.0).otherwise(
        F.least(gap("z"), F.lit(PRICE_CAP))
    )
    family = F.when(F.col("cell_family") == F.col(f"{q}.family"), 0.0).otherwise(FAMILY_PENALTY)
    own_shop = (F.col("shop_min") == F.col("shop_max")) & (F.col("shop_min") == F.col(f"{q}.shop"))
    return F.hypot(gap("x"), gap("y")) + z + family + F.when(own_shop, SHOP_PENALTY).otherwise(0.0)


def levels_for(candidates: DataFrame, per_cell: int = 32) -> int:
    """Depth of the tree so that a finest cell holds about ``per_cell`` candidates (one count)."""
    cells = max(1, candidates.count() // per_cell)
    return max(1, min(10, math.ceil(math.log(cells, _PARTS * _PARTS))))


def nearest_item(items: DataFrame, candidates: DataFrame, *, same_origin: bool, levels: int | None = None) -> DataFrame:
    """Nearest candidate per item: (id, match, distance); items without any candidate are left out.

    Both sides have id, origin, shop, family, x, y, p100. With ``same_origin`` the match shares the
    item's origin; otherwise it has another one. Blends and unknown origins are never a match, and
    have none of the same origin. The depth of the tree follows the number of candidates unless given.
    """
    levels = levels or levels_for(candidates)
    known = (F.coalesce("origin", F.lit("")) != "") & (F.col("origin") != rules.BLEND)
    group = ["origin"] if same_origin else []
    fields = ["id", "origin", "shop", "family", "x", "y", "p100"]
    queries = items.select(*fields)
    if same_origin:
        queries = queries.filter(known)
    queries = _located(queries, levels).withColumn("q", F.struct(*fields, "z")).select("q", "cx", "cy", "cz")
    points = _located(_reduce_same_point(candidates.select(*fields).filter(known)), levels)
    cells = [c.withColumnRenamed("family", "cell_family") for c in _summaries(points, levels, group)]

    def fits(c: str) -> Column:
        """Whether candidate struct ``c`` may answer item ``q``."""
        other = F.col(f"{c}.id") != F.col("q.id")
        return other if same_origin else other & (F.coalesce(F.col("q.origin"), F.lit("")) != F.col(f"{c}.origin"))

    def cell_fits() -> Column:
        if same_origin:
            return F.lit(True)
        only = (F.col("origin_min") == F.col("origin_max")) & (F.col("origin_min") == F.col("q.origin"))
        return ~F.coalesce(only, F.lit(False))

    def origin_key() -> list[Column]:
        return [F.col("q.origin").alias("origin")] if same_origin else []

    # Step 1: the samples of the item's own cells on every level.
    samples = None
    for level, summary in enumerate(cells):
        part = _spread_cells(summary.select(*group, "cx", "cy", "cz", "sample_min", "sample_max"), level)
        part = part.withColumn("_level", F.lit(level))
        # To an unpriced item no price is far: it looks for samples of every price in its x, y cell.
        every = part.groupBy(*group, "cx", "cy", "_share", "_level").agg(
            F.min("sample_min").alias("sample_min"), F.max("sample_max").alias("sample_max"))
        part = part.unionByName(every.withColumn("cz", F.lit(_ANY_PRICE)))
        samples = part if samples is None else samples.unionByName(part)
    own = F.array(*[
        F.struct(
            F.lit(level).alias("_level"), _share_of("q.id", level).alias("_share"),
            *[F.floor(F.col(c) / _PARTS ** (levels - level)).cast("int").alias(c) for c in ("cx", "cy")],
            F.when(F.col("cz") < 0, _ANY_PRICE).otherwise(F.floor(F.col("cz") / _PARTS ** (levels - level)).cast("int")).alias("cz"),
        ) for level in range(levels + 1)
    ])
    met = queries.select("q", *origin_key(), F.inline(own)).join(
        samples, [*group, "_level", "_share", "cx", "cy", "cz"]
    )
    bound = F.least(*[F.when(fits(s), item_distance("q", s)) for s in ("sample_min", "sample_max")])
    # An item whose own cells hold no usable sample keeps a bound that excludes nothing.
    bounds = met.groupBy(F.col("q.id").alias("_id")).agg(F.min(bound).alias("bound"))
    frontier = (
        queries.select("q").join(bounds, F.col("q.id") == F.col("_id"), "left").drop("_id")
        .withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        .select("q", "bound", *origin_key(), *[F.lit(0).alias(c) for c in ("cx", "cy")], F.lit(0).alias("cz"))
    )
    # The root of unpriced candidates is the cell layer -1.
    frontier = frontier.withColumn("cz", F.explode(F.array(F.lit(0), F.lit(-1))))

    # Step 2: open cells level by level.
    for level in range(1, levels + 1):
        children = cells[level]
        children = children.select(
            *children.columns, *[F.floor(F.col(c) / _PARTS).cast("int").alias(f"p{c}") for c in ("cx", "cy", "cz")]
        )
        # The root lies above all families; from there on each family is descended by itself.
        family = [] if level == 1 else ["cell_family"]
        parents = frontier.select("q", "bound", *group, *family, *[F.col(c).alias(f"p{c}") for c in ("cx", "cy", "cz")])
        parents = parents.withColumn("_share", _share_of("q.id", level))
        opened = parents.join(_spread_cells(children, level), [*group, *family, "pcx", "pcy", "pcz", "_share"])
        kept = opened.filter((_least_distance() <= F.col("bound") + _EPS) & cell_fits())
        # The samples of the opened cells lower the bound before the next level.
        near = F.least(*[F.when(fits(s), item_distance("q", s)) for s in ("sample_min", "sample_max")])
        kept = kept.withColumn("bound", F.least("bound", F.min(near).over(Window.partitionBy("q.id"))))
        kept = kept.filter(_least_distance() <= F.col("bound") + _EPS)
        frontier = kept.select("q", "bound", *group, "cell_family", "cx", "cy", "cz")

    # Step 3: the candidates of the cells that are left.
    right = points.select(
        *group, F.col("family").alias("cell_family"), "cx", "cy", "cz", F.struct(*fields).alias("c")
    )
    pairs = frontier.join(right, [*group, "cell_family", "cx", "cy", "cz"]).filter(fits("c"))
    best = pairs.groupBy(F.col("q.id").alias("id")).agg(
        F.min(F.struct(item_distance("q", "c").alias("distance"), F.col("c.id").alias("match"))).alias("best")
    )
    return best.select("id", "best.match", "best.distance")


def next_items(items: DataFrame, candidates: DataFrame, levels: int | None = None) -> DataFrame:
    """Both suggestions per item: (id, same_origin, similar)."""
    levels = levels or levels_for(candidates)
    same = nearest_item(items, candidates, same_origin=True, levels=levels)
    other = nearest_item(items, candidates, same_origin=False, levels=levels)
    return (
        items.select("id")
        .join(same.select("id", F.col("match").alias("same_origin")), "id", "left")
        .join(other.select("id", F.col("match").alias("similar")), "id", "left")
    )
