"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items.

A text is normalised to its words, lower case and with single spaces, and read once by the automaton.
Found windows are mapped back to code-point offsets of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import column, fresh, join_small
from tallyshelf.session import settle

WINDOW = 10
#: Benchmark text per automaton. Its windows hold each word WINDOW times, so an automaton takes some
#: 200 bytes of a worker's memory per byte of text. A larger benchmark goes in several such blocks.
BLOCK_BYTES = 512 * 1024

# Words are runs of a-z, 0-9 and everything beyond ASCII, after A-Z are lower-cased.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_SPANS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = ("struct<n_words: bigint, n_hit: bigint, items: array<string>, "
          "spans: array<struct<start: bigint, stop: bigint>>, contaminated: boolean>")
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("contaminated", pa.bool_())])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()


def build(items: list[tuple[str, str]], window: int = WINDOW):
    """Automaton over all windows of ``items`` (id, text); a window knows its length and its items."""
    windows: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            found = " " + b" ".join(w[i:i + size]).decode() + " "
            windows.setdefault(found, (size, set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for found, value in windows.items():
        automaton.add_word(found, value)
    if windows:
        automaton.make_automaton()
    return automaton


def scan(automaton, text: str | None) -> dict:
    """Words of a text under any occurrence of a window, as a count and as spans of the text."""
    w = words(text)
    out = {"n_words": len(w), "n_hit": 0, "items": [], "spans": [], "contaminated": False}
    if not w or not len(automaton):
        return out
    normal = " " + b" ".join(w).decode() + " "
    found = list(automaton.iter(normal))
    if not found:
        return out
    # The space that ends word k is the (k + 1)-th after the leading one.
    spaces = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), "<u4") == 32)
    lasts = np.searchsorted(spaces, [end for end, _ in found])
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, lasts - np.array([size for _, (size, _) in found]), 1)
    np.add.at(edge, lasts, -1)
    hit = np.cumsum(edge[:-1]) > 0
    places = [m.span() for m in _SPANS.finditer(text)]
    runs = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    out["n_hit"] = int(hit.sum())
    out["items"] = sorted(set().union(*(items for _, (_, items) in found)))
    out["spans"] = [{"start": places[a][0], "stop": places[b - 1][1]} for a, b in zip(runs[::2], runs[1::2])]
    out["contaminated"] = True
    return out


_BUILT: dict = {}


def _automaton(key: str, shared, window: int):
    """The automaton of this Python worker: built once, used by all tasks of a scan."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build(shared.value, window)
    return _BUILT[key]


def _scanner(spark, items: list[tuple[str, str]], window: int):
    shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.arrow_udf(RESULT)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(key, shared, window)
        for batch in batches:
            yield pa.array([scan(automaton, t) for t in batch.to_pylist()], _ARROW)

    return scanned


def _blocks(bench: DataFrame, limit: int):
    """The items in lists of at most ``limit`` bytes of text, or one item; each list fits the driver."""
    known = settle(bench.filter(F.col("text").isNotNull()).distinct())
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    for k in range(n):
        part = known if n == 1 else known.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows: list[tuple[str, str]] = []
        size = 0
        for r in part.toLocalIterator():
            if rows and size + len(r["text"]) > limit:
                yield rows
                rows, size = [], 0
            rows.append((r["item"], r["text"]))
            size += len(r["text"])
        yield rows


def mark(docs: DataFrame, benchmark: DataFrame, into: str, text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add the struct ``into`` (see RESULT) to every row of ``docs``.

    Null and empty texts and texts without a word have no words and no hits; a null or wordless item
    never occurs. Rows of one item id count as one item, null ids together as the item ''. Repeated
    documents each keep their row, an empty benchmark hits nothing, texts are read whole at any length.
    A benchmark beyond ``block_bytes`` is searched block by block and the hits of a text are united.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(column(item).cast("string"), F.lit("")).alias("item"),
                             column(item_text).alias("text"))
    blocks = _blocks(bench, block_bytes)
    first, second = next(blocks), next(blocks, None)
    marked = docs.withColumn(into, _scanner(spark, first, window)(column(text)))
    if second is None:
        return marked
    key, more = fresh(marked, "_key", "_more")
    texts = docs.select(column(text).alias("text")).filter(F.col("text").isNotNull())
    hits = None
    while second is not None:
        part = texts.select(F.struct(F.xxhash64("text").alias("a"), F.md5("text").alias("b")).alias(key),
                            _scanner(spark, second, window)("text").alias("r"))
        part = settle(part.filter(F.col("r.contaminated")).dropDuplicates([key]))
        hits = part if hits is None else hits.unionAll(part)
        second = next(blocks, None)
    hits = settle(hits.groupBy(key).agg(
        F.flatten(F.collect_list("r.spans")).alias("spans"), F.flatten(F.collect_list("r.items")).alias("items")))
    joined = join_small(
        marked.withColumn(key, F.struct(F.xxhash64(column(text)).alias("a"), F.md5(column(text)).alias("b"))),
        hits.select(key, F.struct("spans", "items").alias(more)), [key], "left", 4096)
    united = F.arrow_udf(_unite, RESULT)(column(text), column(into), column(more))
    return joined.withColumn(into, united).select(*[column(c) for c in marked.columns])


def _unite(texts: pa.Array, own: pa.Array, more: pa.Array) -> pa.Array:
    """Hits of one text from several blocks, as one."""
    out = []
    for text, a, b in zip(texts.to_pylist(), own.to_pylist(), more.to_pylist()):
        if b:
            hit = [False] * (len(text) + 1)
            for s in a["spans"] + b["spans"]:
                hit[s["start"]:s["stop"]] = [True] * (s["stop"] - s["start"])
            places = [m.span() for m in _SPANS.finditer(text)]
            under = [hit[start] for start, _ in places]
            spans = []
            for k, (start, stop) in enumerate(places):
                if under[k] and k and under[k - 1]:
                    spans[-1]["stop"] = stop
                elif under[k]:
                    spans.append({"start": start, "stop": stop})
            a = {"n_words": a["n_words"], "n_hit": sum(under), "spans": spans,
                 "items": sorted({*a["items"], *b["items"]}), "contaminated": True}
        out.append(a)
    return pa.array(out, _ARROW)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no window of any item, with the columns they came with."""
    (r,) = fresh(docs, "_r")
    return mark(docs, benchmark, r, text, **options).filter(~column(r)["contaminated"]).select(
        *[column(c) for c in docs.columns])
