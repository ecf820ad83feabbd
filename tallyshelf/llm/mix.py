"""Mixing sources to target weights by Pareto order sampling.

A source that must give ``ratio`` times its size gives every document ``floor(ratio)`` times for certain.
For the rest each document draws a uniform number u and is ranked by its random odds u / (1 - u) divided
by its inclusion odds; the sample is the start of that order up to a fixed size, measured in the words
that are still missing. Draws are hashes of the seed and the document, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.llm.common import column, fresh, join_small, word_count
from tallyshelf.session import settle

#: No document is taken more often.
MOST_COPIES = 3
#: Ranks fall into so many bins by their place between 0 and 1; only the bin of the cut is sorted.
BINS = 1 << 12
#: So many documents beyond the cut, each of the size nearest to the words still missing, close a sample.
LAST_PLACES = 4
#: Words at which a document has half the preference of a very long one: short scraps are taken less.
HALF_SIZE = 100


def draw(key: Column, text: Column, seed: str) -> Column:
    """Uniform number in (0, 1) of a document: 52 bits of a hash."""
    digest = F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"),
                            F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def _sized(docs: DataFrame, into: str, key: str, text: str, source: str, seed: str) -> DataFrame:
    """Add the struct ``into``: what of a document decides how often it is taken."""
    return docs.withColumn(into, F.struct(
        column(key).cast("string").alias("key"), column(source).cast("string").alias("source"),
        word_count(column(text)).alias("size"), draw(column(key), column(text), seed).alias("u")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Target words per source from rows (source, source_size), one per source.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a source stops at
    MOST_COPIES times its size and the excess is shared again. The shares that result are
    min(cap, weight * level); the level follows from the sources ordered by cap / weight. Only the rows
    of the source list, one per source, pass through these windows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    cap = (MOST_COPIES * F.col("source_size")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap)
    upto = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rest = upto.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # Were the sources before this one full and all from here on open, this would be the level. It is the
    # level at the first source that it leaves open.
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    found = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(Window.partitionBy())["level"]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(
        found * F.col("weight"), F.col("cap"))).alias("target"))


def plan(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source that says who is taken: ``copies`` of every document, one more up to ``cut``.

    ``sized`` has the fields of ``_sized`` as columns and is read several times, so it should be settled.
    A source may hold any share of the rows: its words are added up per bin of rank before the shuffle,
    and only the rows of the bin in which the missing words run out are ordered. ``lasts`` are documents
    beyond the cut, each that whose size comes nearest to the words still missing then.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = settle(targets(sizes, weights).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("missing", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("part", F.when(F.col("source_size") > 0, F.col("missing") / F.col("source_size")).otherwise(0.0)))
    here = F.col("s.source").eqNullSafe(F.col("g.source"))
    ranked = sized.alias("s").filter("size > 0").join(goals.filter("part > 0").alias("g"), here).select(
        F.col("g.source").alias("source"), "size", "missing", F.struct(
            rank(F.col("u"), F.col("size"), F.col("part")).alias("q"), F.col("s.key").alias("key")).alias("at"))
    ranked = ranked.withColumn("bin", _bin(F.col("at.q")))
    bins = ranked.groupBy("source", "missing", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin")
    edge = bins.withColumn("before", F.sum("words").over(upto) - F.col("words")).filter(
        (F.col("before") <= F.col("missing")) & (F.col("before") + F.col("words") > F.col("missing")))
    edge = settle(edge.select("source", "bin", "before", "missing"))
    inside = ranked.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (
        F.col("r.bin") == F.col("e.bin"))).select(
        "e.source", "e.bin", "e.before", "e.missing", "r.at", "r.size")
    # Rows that share their whole rank are repeated rows; they fall on the same side of the cut.
    tied = inside.groupBy("source", "bin", "before", "missing", "at").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source", "bin").orderBy("at")
    run = tied.withColumn("sum", F.col("before") + F.sum("size").over(order))
    cuts = run.groupBy("source", "bin", "before", "missing").agg(
        F.max(F.when(F.col("sum") <= F.col("missing"), F.col("at"))).alias("cut"),
        F.max(F.when(F.col("sum") <= F.col("missing"), F.col("sum"))).alias("sum"))
    cuts = settle(cuts.select("source", "bin", "cut", (
        F.col("missing") - F.coalesce(F.col("sum"), F.col("before").cast("double"))).alias("left")))
    state = cuts.withColumn("lasts", F.array().cast("array<struct<q: double, key: string>>"))
    for _ in range(LAST_PLACES):
        beyond = ranked.alias("r").join(state.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).filter(
            (F.col("r.size") < 2 * F.col("left")) & ~F.array_contains("lasts", F.col("r.at"))
            & ~_taken(F.col("r.bin"), F.col("r.at"), F.col("c.bin"), F.col("c.cut")))
        one = beyond.groupBy("c.source").agg(F.min(F.struct(
            F.abs(F.col("r.size") - F.col("left")).alias("off"), F.col("r.at").alias("at"), F.col("r.size").alias("size"))).alias("one"))
        state = settle(state.alias("s").join(one.alias("o"), F.col("s.source").eqNullSafe(F.col("o.source")), "left").select(
            "s.source", "s.bin", "s.cut", (F.col("left") - F.coalesce(F.col("one.size"), F.lit(0))).alias("left"),
            F.when(F.col("one").isNull(), F.col("lasts")).otherwise(F.array_append("lasts", F.col("one.at"))).alias("lasts")))
    return settle(goals.alias("g").join(state.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select(
        "g.source", "g.source_size", "g.target", "g.copies", "g.part", F.col("c.bin").alias("cut_bin"), "c.cut", "c.lasts"))


def rank(u: Column, size: Column, part: Column) -> Column:
    """Random odds over inclusion odds. The odds of the part that is wanted are weighed by preference.
    Null where nothing of a source or of a document is wanted."""
    preference = size / (size + F.lit(float(HALF_SIZE)))
    return (u / (1 - u)) / F.nullif(part / (1 - part) * preference, F.lit(0.0))


def _bin(q: Column) -> Column:
    return F.floor(q / (1 + q) * BINS).cast("int")


def _taken(bin_: Column, at: Column, cut_bin: Column, cut: Column) -> Column:
    return (bin_ < cut_bin) | ((bin_ == cut_bin) & F.coalesce(at <= cut, F.lit(False)))


def mix(docs: DataFrame, into: str, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = (1, 2, 3), seed: str = "mix-1") -> DataFrame:
    """Add the struct ``into``: size, source_size, target of its source, and copies (0 to MOST_COPIES).

    A null source is a source of its own, a null or empty text has size 0 and is taken as often as its
    source takes everyone. Rows that repeat id and text are taken alike. An empty table gives none; sizes
    are of whole texts. Ties in rank go by id.
    """
    (f,) = fresh(docs, "_f")
    narrow = settle(_sized(docs.select(column(key).alias("k"), column(text).alias("t"), column(source).alias("s")),
                           "f", "k", "t", "s", seed).select("f.*"))
    sources = plan(narrow, weights).select(F.struct("*").alias("p"), F.coalesce(F.col("source"), F.lit("")).alias("n"),
                                           F.col("source").isNull().alias("m"))
    p, n, m = fresh(docs.withColumn(f, F.lit(0)), "_p", "_n", "_m")
    out = _sized(docs, f, key, text, source, seed).withColumn(
        n, F.coalesce(column(source).cast("string"), F.lit(""))).withColumn(m, column(source).isNull())
    out = join_small(out, sources.toDF(p, n, m), [n, m], "left", 512)
    at = F.struct(rank(column(f)["u"], column(f)["size"], column(p)["part"]).alias("q"), column(f)["key"].alias("key"))
    more = (column(p)["part"] > 0) & (column(f)["size"] > 0) & (
        _taken(_bin(at["q"]), at, column(p)["cut_bin"], column(p)["cut"]) | F.coalesce(F.array_contains(column(p)["lasts"], at), F.lit(False)))
    return out.withColumn(into, F.struct(
        column(f)["size"].alias("size"), column(p)["source_size"].alias("source_size"), column(p)["target"].alias("target"),
        (column(p)["copies"] + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).cast("bigint").alias("copies"),
    )).select(*[column(c) for c in docs.columns], column(into))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns it came with."""
    m, k = fresh(docs, "_mix", "_k")
    taken = mix(docs, m, **options)
    return taken.withColumn(k, F.explode(F.array_repeat(F.lit(0), column(m)["copies"].cast("int")))).select(
        *[column(c) for c in docs.columns])
