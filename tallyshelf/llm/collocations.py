"""Phrase mining by set-oriented joins of occurrence relations (SETM), phrase by one word longer at a time.

The occurrence relation of a level holds, per text, the sorted places of its frequent phrases and which phrase
begins there. A place counts the words of the text and skips one number at each border of pieces, so it stands
for piece and position at once: neighbouring places are neighbouring words of one piece. A level is found from
the one before by a merge join of its relation with itself on adjacent places, a group count of the joined
pairs, and a semi join with the pairs that are frequent. Each level's relation is a written table.

Counts and joins of phrases run in Spark; inside a task the merge join is a shift over a text's sorted places.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyshelf.llm.common import batches_of, column, shared_folder
from tallyshelf.session import settle

LEAST, LONGEST, TOP = 100, 5, 2000
#: Frequent phrases of one level that a task looks up in memory, 24 bytes each (words some 150); beyond it the
#: occurrences are joined with them by a shuffle.
IN_MEMORY = 500_000
#: Pairs, and distinct words, counted in a task before the counts go on.
COUNTED, WORDS = 1 << 20, 1 << 18
#: Texts and relation rows that pass to a task at a time.
ROWS = 256

_TO_PIECES = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_RELATION = pa.schema([("row", pa.int64()), ("gaps", pa.binary()), ("ids", pa.binary())])
_RELATION_SQL = "row bigint, gaps binary, ids binary"


def occurrences(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    """Words of a text in order, and their places."""
    flat: list[bytes] = []
    sizes = []
    for piece in (text or b"").translate(_TO_PIECES).split(b"\n"):
        found = piece.split()
        flat += found
        sizes.append(len(found))
    return flat, np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)


def _packed(row, places: np.ndarray, ids: np.ndarray):
    return row, np.diff(places, prepend=0).astype(np.int32).tobytes(), ids.astype(np.int64).tobytes()


def _unpacked(gaps: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(gaps, np.int32), dtype=np.int64), np.frombuffer(ids, np.int64)


def _joined(places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a sorted relation with itself: places with a phrase at the next place, and both phrases."""
    here = np.flatnonzero(places[1:] == places[:-1] + 1)
    return places[here], ids[here], ids[here + 1]


def _pieces(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"),
                       column(text).cast("string").cast("binary").alias("text"))


_WORD_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, of in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of)), pa.array(list(of), pa.binary()),
                                              pa.array(list(of.values()), pa.int64())], schema=_WORD_COUNTS)
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            counts.setdefault(lang, Counter()).update((text.as_py() or b"").translate(_TO_PIECES).split())
        if sum(map(len, counts.values())) > WORDS:
            yield from out()
    yield from out()


_PAIR_COUNTS = pa.schema([("first", pa.int64()), ("second", pa.int64()), ("n", pa.int64())])


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    firsts, seconds, held = [], [], 0

    def out() -> pa.RecordBatch:
        ids, ranks = np.unique(np.concatenate([*firsts, *seconds]), return_inverse=True)
        n = len(ranks) // 2
        pairs, counts = np.unique(ranks[:n] * np.int64(len(ids)) + ranks[n:], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ids[pairs // len(ids)]), pa.array(ids[pairs % len(ids)]),
                                           pa.array(counts.astype(np.int64))], schema=_PAIR_COUNTS)

    for batch in batches:
        for gaps, ids in zip(batch.column("gaps"), batch.column("ids")):
            _, a, b = _joined(*_unpacked(gaps.as_py(), ids.as_py()))
            if len(a):
                firsts.append(a)
                seconds.append(b)
                held += len(a)
            if held > COUNTED:
                yield out()
                firsts, seconds, held = [], [], 0
    if held:
        yield out()


def _write(relation: DataFrame, level: int) -> DataFrame:
    """The relation as a written table; row numbers stay what they are from here on."""
    path = shared_folder(relation.sparkSession, f"occurrences-{level}")
    with batches_of(relation.sparkSession, ROWS):
        relation.write.option("compression", "zstd").parquet(path)
    return relation.sparkSession.read.schema(_RELATION_SQL).parquet(path)


def _pack_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, place, id), sorted, as one relation row per text."""
    row, places, ids = None, [], []
    for batch in batches:
        r, p, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "place", "id"))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(r)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if row is not None and r[a] != row:
                yield _pieces([_packed(row, np.concatenate(places), np.concatenate(ids))], _RELATION)
                places, ids = [], []
            row = int(r[a])
            places.append(p[a:b])
            ids.append(i[a:b])
    if row is not None:
        yield _pieces([_packed(row, np.concatenate(places), np.concatenate(ids))], _RELATION)


def _shuffled(flat: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Semi join by a shuffle, for more groups than a task holds; Spark splits the groups that are very frequent."""
    kept = flat.join(groups.select(*on, "id"), on).select("row", "place", "id")
    return kept.repartition("row").sortWithinPartitions("row", "place").mapInArrow(_pack_sorted, _RELATION_SQL)


def _first_relation(texts: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """Occurrences of the frequent words."""
    if small:
        known: dict[str, dict[bytes, int]] = {}
        for r in groups.select("lang", "word", "id").toLocalIterator():
            known.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
        shared = texts.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, held = [], 0
                for row, lang, text in zip(*(batch.column(c) for c in ("row", "lang", "text"))):
                    flat, places = occurrences(text.as_py())
                    ids = np.fromiter(map(shared.value.get(lang.as_py(), {}).get, flat, repeat(-1)), np.int64, len(flat))
                    kept = ids >= 0
                    rows.append(_packed(row.as_py(), places[kept], ids[kept]))
                    held += len(flat)
                    if held > COUNTED:
                        yield _pieces(rows, _RELATION)
                        rows, held = [], 0
                if rows:
                    yield _pieces(rows, _RELATION)

        return texts.mapInArrow(run, _RELATION_SQL)
    schema = pa.schema([("row", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("place", pa.int64())])

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lang, text in zip(*(batch.column(c) for c in ("row", "lang", "text"))):
                flat, places = occurrences(text.as_py())
                for k in range(0, len(flat), COUNTED):
                    part = flat[k:k + COUNTED]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(part)), pa.array([lang.as_py()] * len(part)),
                                                      pa.array(part, pa.binary()), pa.array(places[k:k + COUNTED])], schema=schema)

    return _shuffled(texts.mapInArrow(flatten, "row bigint, lang string, word binary, place bigint"), groups, ["lang", "word"])


def _next_relation(relation: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """Occurrences of the frequent phrases that are one word longer than those of ``relation``."""
    if small:
        rows = groups.select("first", "second", "id").toPandas()
        shared = relation.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy(np.int64) for c in rows.columns))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second, new = shared.value
            known = np.unique(np.concatenate([first, second]))
            pairs = np.searchsorted(known, first) * len(known) + np.searchsorted(known, second)
            order = np.argsort(pairs)
            pairs, new = pairs[order], new[order]
            for batch in batches:
                out = []
                for row, gaps, ids in zip(*(batch.column(c) for c in ("row", "gaps", "ids"))):
                    places, a, b = _joined(*_unpacked(gaps.as_py(), ids.as_py()))
                    if not len(a) or not len(pairs):
                        continue
                    ra, rb = (np.minimum(np.searchsorted(known, x), len(known) - 1) for x in (a, b))
                    wanted = ra * len(known) + rb
                    at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
                    kept = (pairs[at] == wanted) & (known[ra] == a) & (known[rb] == b)
                    if kept.any():
                        out.append(_packed(row.as_py(), places[kept], new[at[kept]]))
                if out:
                    yield _pieces(out, _RELATION)

        return relation.mapInArrow(run, _RELATION_SQL)
    schema = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, gaps, ids in zip(*(batch.column(c) for c in ("row", "gaps", "ids"))):
                places, a, b = _joined(*_unpacked(gaps.as_py(), ids.as_py()))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row.as_py(), np.int64)), pa.array(places),
                                                      pa.array(a), pa.array(b)], schema=schema)

    return _shuffled(relation.mapInArrow(flatten, "row bigint, place bigint, first bigint, second bigint"), groups, ["first", "second"])


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                     in_memory: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, phrase, size, a) of one to ``longest`` words that occur ``least`` times or more within
    pieces, overlaps included; and the number of words (lang, n) of each language.

    A null text has no words, a null language is ``und``. Repeated rows count each time. An empty table, or
    one without a frequent word, gives no phrases. Texts are read whole; other columns may have any name.
    """
    in_memory = IN_MEMORY if in_memory is None else in_memory
    texts = _texts(docs, text, lang)
    with batches_of(docs.sparkSession, ROWS):
        words = settle(texts.drop("row").mapInArrow(_count_words, "lang string, word binary, n bigint").groupBy("lang", "word").agg(
            F.sum("n").alias("a")))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    groups = settle(words.filter(F.col("a") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", "word", "a"))
    count = groups.count()
    relation = _write(_first_relation(texts, groups, count <= in_memory), 1) if count else None
    named = groups.select("id", "lang", F.col("word").cast("string").alias("phrase"), "a")
    levels = [named.withColumn("size", F.lit(1))]
    for size in range(2, longest + 1):
        if not count:
            break
        with batches_of(docs.sparkSession, ROWS):
            pairs = settle(relation.select("gaps", "ids").mapInArrow(_count_pairs, "first bigint, second bigint, n bigint").groupBy(
                "first", "second").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
        before = named.select("id", "lang", "phrase")
        named = settle(pairs.join(before.toDF("first", "lang", "head"), "first").join(
            before.select(F.col("id").alias("second"), F.substring_index("phrase", " ", -1).alias("last")), "second").select(
            F.monotonically_increasing_id().alias("id"), "first", "second", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "a"))
        count = named.count()
        levels.append(named.select("id", "lang", "phrase", "a").withColumn("size", F.lit(size)))
        if count and size < longest:
            relation = _write(_next_relation(relation, named, count <= in_memory), size)
    phrases = reduce(DataFrame.unionAll, levels).select("lang", "phrase", "size", "a")
    return settle(phrases), totals


def collocations(phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by how much more often than by chance their parts meet.

    Cutting a phrase after k words gives floor(1000 * a * n / (l * r)); its lowest cut counts, the smallest k
    on ties. A phrase that a longer one always goes with is left out; as a longer phrase is never more
    frequent than what it holds, the phrases of one more word decide that. Arithmetic is in decimals of 38
    digits. Ties go by a, then by phrase in byte order, so ranks are the same in every run.
    """
    long = phrases.filter("size > 1")
    words, last = F.split("phrase", " "), F.col("size")
    covered = phrases.filter("size > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(words, 1, last - 1), " "), F.array_join(F.slice(words, 2, last - 1), " "))).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("a").alias("longer"))
    kept = long.join(covered, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")
    cuts = kept.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), last - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("k") + 1, last - F.col("k")), " ").alias("tail"))
    parts = phrases.select("lang", "phrase", "a")
    cuts = cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(parts.toDF("lang", "tail", "r"), ["lang", "tail"]).join(
        totals, "lang")
    score = F.expr("CAST(1000 * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) DIV "
                   "(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
