"""Messages about what a run found: which events are worth one, and their wording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.functions.rounding import round_even

# Labels of the event types in the long digest.
LABELS = {"new": "⤴ 新着", "restock": "↻ 再入荷", "soldout": "✕ 売り切れ"}


def pick_events(events: DataFrame) -> DataFrame:
    """Restocks, and new items whose title names a rare lot; adds the column rare."""
    rare = (F.col("type") == "new") & F.coalesce("title", F.lit("")).rlike(rules.DIGEST_RARE)
    return events.withColumn("rare", rare).filter(F.col("rare") | (F.col("type") == "restock"))


def push_message(events: DataFrame, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """At most one short message per run: (title, body, url, tag). No row when nothing is picked.

    ``order`` is the order of the events; the first rare lot, else the first restock, is named.
    Only counters and two head rows are combined, so the number of events does not matter.
    """
    picked = pick_events(events)
    item = F.struct("title", "shop", "oos_hours")
    place = F.struct(*order)
    restock = F.col("type") == "restock"
    summary = picked.groupBy(*group).agg(
        F.count_if(restock).alias("n_restock"), F.count_if("rare").alias("n_rare"),
        F.min_by(item, F.when(restock, place)).alias("restock"),
        F.min_by(item, F.when(F.col("rare"), place)).alias("rare"),
    ).filter(F.col("n_restock") + F.col("n_rare") > 0)

    def name(e: str) -> Column:
        return F.concat(F.col(f"{e}.title"), F.lit(" — "), F.col(f"{e}.shop"))

    one_restock = (F.col("n_restock") == 1) & (F.col("n_rare") == 0)
    one_rare = (F.col("n_rare") == 1) & (F.col("n_restock") == 0)
    days = round_even(F.col("restock.oos_hours") / 24).cast("bigint").cast("string")
    back = F.when(F.coalesce(F.col("restock.oos_hours"), F.lit(0.0)) != 0,
                  F.concat(F.lit("（約"), days, F.lit("日ぶり）"))).otherwise("")
    # Wording of the messages.
    counts = F.concat_ws(
        "・",
        F.when(F.col("n_restock") > 0, F.concat(F.lit("再入荷 "), F.col("n_restock"), F.lit("件"))),
        F.when(F.col("n_rare") > 0, F.concat(F.lit("新着レアロット "), F.col("n_rare"), F.lit("件"))),
    )
    head = F.when(F.col("n_rare") > 0, name("rare")).otherwise(name("restock"))
    return summary.select(
        *group,
        F.when(one_restock, "再入荷しました").when(one_rare, "レアロットが入りました").otherwise(counts).alias("title"),
        F.when(one_restock, F.concat(name("restock"), back)).when(one_rare, name("rare"))
        .otherwise(F.concat(head, F.lit(" ほか"))).alias("body"),
        F.when(F.col("n_rare") > 0, "?v=geisha").otherwise("?v=zukan").alias("url"),
        F.when(one_restock, "restock").when(one_rare, "rare").otherwise("digest").alias("tag"),
    )


def long_digest(events: DataFrame, order: Sequence[Column], limit: int = 15, chars: int = 1900) -> DataFrame:
    """One text naming the first ``limit`` events, cut to ``chars``: (content)."""
    label = F
    for kind, text in LABELS.items():
        label = label.when(F.col("type") == kind, text)
    days = round_even(F.col("oos_hours") / 24, 1).cast("string")
    extra = F.when(F.coalesce("oos_hours", F.lit(0.0)) != 0,
                   F.concat(F.lit("（約"), days, F.lit("日ぶり）"))).otherwise("")
    line = F.concat(
        label.otherwise(F.col("type")), F.lit(" **"), F.col("title"), F.lit("** — "), F.col("shop"), F.lit(" "), extra,
        F.lit("\n<"), F.col("url"), F.lit(">"),
    )
    head = events.orderBy(*order).limit(limit).withColumn("_line", line)
    numbered = head.withColumn("_place", F.struct(*[F.monotonically_increasing_id()]))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_line"))), lambda r: r["_line"])
    text = numbered.agg(F.array_join(lines, "\n").alias("content"), F.count(F.lit(1)).alias("n"))
    return text.filter(F.col("n") > 0).select(F.substring("content", 1, chars).alias("content"))
