"""Near-duplicate documents by an LSH forest over MinHash signatures, every link confirmed on full sets.

A document is the set of its distinct word shingles. Documents of equal sets are one node. A node's
signature is cut into ORDERS keys of DEPTH values; each order sorts all nodes by its key, so that nodes
with long common prefixes are neighbours. A node is compared with the next WINDOW nodes that share at
least the first value: where few nodes share it, these are the whole region, where many do, the sort has
brought the deepest matches together. That is the forest's adaptive depth. Regions that stay larger than
the window at depth CROWDED are crowded; there, whoever did not end up in the region's main component meets
everyone in the region who is not connected to it yet, block by block, whatever the region's size: two sets
this alike share one of the rarest fifth of either's shingles, and those that do are compared in full.

Two sets of similarity s agree in the first d values of some order with probability 1 - (1 - s^d)^ORDERS:
for s = 0.8 all but 7e-12 (d = 1), 8e-8 (d = 2) and 1e-5 (d = 3).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import column, fresh, join_small
from tallyshelf.llm.components import components
from tallyshelf.session import settle

ORDERS, DEPTH, WINDOW, CROWDED = 16, 6, 8, 3
#: Nodes and bytes of sets per block when pairs are confirmed, and bytes per block of a crowded region.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Nodes from which a crowded region is also dealt by the sets' sizes; only pairs whose sizes alone rule a link out are left out.
LARGE_REGION = 4096
#: Rows of texts that pass to a task at a time, and pairs that one looks at at a time.
TEXTS, PAIRS = 256, 1 << 18
#: Of ORDERS * DEPTH signature values a pair agrees in at least this share to be confirmed: 5.5 standard
#: deviations below the similarity asked for.
SLACK = 5.5

_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xBF58476D1CE4E5B9)
#: Odd multipliers, one per signature value, by a fixed rule.
_FACTORS = (np.arange(1, ORDERS * DEPTH + 1, dtype=np.uint64) * _ONE) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _TWO
    return x ^ (x >> np.uint64(32))


_FACTORS = _mix(_mix(_FACTORS)) | np.uint64(1)
#: A random number for each byte at each of the first 256 places of a word; a word's hash is their sum. Later places
#: reuse them, times an odd number of their own.
_BYTES = _mix(_mix(np.arange(1, 65537, dtype=np.uint64) * _ONE))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are hashed at a time, up to the next space.
_PART = 1 << 18


def _words(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in order."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
    values = _BYTES[((place & 255) << 8) | raw[at]]
    if place.max() > 255:
        values *= _mix((place >> 8).astype(np.uint64) * _ONE) | np.uint64(1)
    return _mix(np.add.reduceat(values, starts))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; a text of fewer words is one shingle."""
    data, parts, at = (text or "").encode("utf-8", "replace").lower(), [], 0
    while at < len(data):
        stop = at + _PART
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        parts.append(_words(data[at:stop]))
        at = stop
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    rows = len(hashes) - size + 1
    out = hashes[:rows]
    for j in range(1, size):
        out = _mix(out * _ONE + hashes[j:rows + j])
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """ORDERS * DEPTH least values of a set under as many hash functions."""
    parts = [((sets[None, k:k + 4096] * _FACTORS[:, None]) >> np.uint64(32)).min(axis=1) for k in range(0, len(sets), 4096)]
    return np.min(parts, axis=0).astype(np.uint32)


_SKETCH = "id bigint, n_shingles bigint, digest binary, key binary, low binary"


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, lows = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                sig = signature(found) if len(found) else np.zeros(0, np.uint32)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(sig.astype(">u4").tobytes())
                lows.append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.binary()), pa.array(lows, pa.binary())],
                ["id", "n_shingles", "digest", "key", "low"])
    return run


def _least_agreement(threshold: int) -> int:
    n, s = ORDERS * DEPTH, threshold / 100
    return max(1, int(n * s - SLACK * (n * s * (1 - s)) ** 0.5))


def _neighbours(threshold: int):
    """Pairs (a, b, agreement) of sorted rows, and rows (a, region) of crowded regions.

    Works through one partition of the sorted orders with a window that is carried from batch to batch.
    A region cut by a partition's end loses the pairs across that end in this one order of ORDERS.
    """
    least = _least_agreement(threshold)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agreement", pa.int32()), ("region", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            new = [np.frombuffer(b"".join(batch.column("sorted").to_pylist()), np.uint8).reshape(rows, 1 + 4 * DEPTH),
                   np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(rows, ORDERS * DEPTH),
                   batch.column("id").to_numpy(zero_copy_only=False), batch.column("n_shingles").to_numpy(zero_copy_only=False)]
            old = 0 if tail is None else len(tail[2])
            keys, low, ids, sizes = new if tail is None else [np.concatenate(x) for x in zip(tail, new)]
            found, crowd = [], []
            for j in range(1, min(WINDOW, len(ids) - 1) + 1):
                first = np.arange(max(0, old - j), len(ids) - j)
                same = first[(keys[first, :5] == keys[first + j, :5]).all(axis=1) & (ids[first] != ids[first + j])]
                agree = (low[same] == low[same + j]).sum(axis=1)
                na, nb = sizes[same], sizes[same + j]
                ok = (agree >= least) & (100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb))
                a, b = ids[same[ok]], ids[same[ok] + j]
                found.append((np.minimum(a, b), np.maximum(a, b), agree[ok]))
                if j == WINDOW:
                    full = first[(keys[first, :1 + 4 * CROWDED] == keys[first + j, :1 + 4 * CROWDED]).all(axis=1)]
                    crowd = np.unique(np.concatenate([full, full + j]))
            if found:
                a, b, n = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(n.astype(np.int32)), pa.nulls(len(a), pa.binary())], schema=schema)
            if len(crowd):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[crowd]), pa.nulls(len(crowd), pa.int64()), pa.nulls(len(crowd), pa.int32()),
                     pa.array([k.tobytes() for k in keys[crowd, :1 + 4 * CROWDED]], pa.binary())], schema=schema)
            tail = [x[-WINDOW:] for x in (keys, low, ids, sizes)]
    return run


class _Sets:
    """The sets of a block, and which nodes its confirmed links have joined so far."""

    def __init__(self, ids, blobs):
        self.of: dict[int, list[np.ndarray]] = {}
        for i, blob in zip(ids, blobs):
            self.of.setdefault(i, []).append(np.frombuffer(blob, np.uint64))
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while self.parent.get(root, root) != root:
            root = self.parent[root]
        while self.parent.get(x, x) != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x: int, y: int) -> None:
        self.parent[self.find(x)] = self.find(y)

    def linked(self, a: int, b: int, threshold: int) -> bool:
        return any(_linked(x, y, threshold) for x in self.of[a] for y in self.of[b])


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=_LINKS)


def _confirm(threshold: int):
    """Confirmed links of a block pair, most alike first; nodes already connected need no second link."""
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        known, out = _Sets(sets["id"].to_pylist(), sets["shingles"].to_pylist()), []
        a, b, agreement = (pairs[c].to_numpy() for c in ("a", "b", "agreement"))
        for k in np.lexsort((b, a, -agreement)):
            x, y = int(a[k]), int(b[k])
            if known.find(x) != known.find(y) and known.linked(x, y, threshold):
                known.join(x, y)
                out.append((x, y))
        return _links(out)
    return run


def _prefix(size: int, threshold: int) -> int:
    """Shingles of a set, the rarest first, of which a linked set must hold one."""
    return size - -(-threshold * size // 100) + 1


def _compare(threshold: int):
    """Links between the stray nodes and the members of one block pair of a crowded region.

    Shingles are ranked by how many of the block pair's sets hold them. A stray is compared in full with the
    members that share one of its and of their rarest shingles, those that share most of them first.
    """
    def run(rows: pa.Table) -> pa.Table:
        stray = rows["stray"].to_numpy()
        ids, components = rows["id"].to_numpy(), rows["component"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        members, strays = np.flatnonzero(~stray), np.flatnonzero(stray)
        if not len(members) or not len(strays):
            return _links([])
        held, ranks, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.empty(len(held), np.int64)
        order[np.argsort(counts, kind="stable")] = np.arange(len(held))
        ranks = order[ranks]
        sizes = np.array([len(x) for x in sets])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        rare = [np.sort(ranks[starts[k]:starts[k + 1]])[:_prefix(int(sizes[k]), threshold)] for k in range(len(sets))]
        keys = np.concatenate([rare[k] for k in members])
        owners = np.repeat(members, [len(rare[k]) for k in members])
        by_key = np.argsort(keys, kind="stable")
        keys, owners = keys[by_key], owners[by_key]
        known, out = _Sets([], []), []
        for k in strays:
            low, high = np.searchsorted(keys, rare[k], "left"), np.searchsorted(keys, rare[k], "right")
            shared = np.zeros(len(sets), np.int32)
            for i, j in zip(low, high):
                shared[owners[i:j]] += 1
            near = np.flatnonzero(shared)
            near = near[100 * np.minimum(sizes[near], sizes[k]) >= threshold * np.maximum(sizes[near], sizes[k])]
            near = near[np.argsort(-shared[near], kind="stable")]
            own = sets[k]
            while len(near):
                # Whoever is connected by now needs no second link.
                home = known.find(int(components[k]))
                near = near[[known.find(int(c)) != home for c in components[near]]]
                now = max(1, int(np.searchsorted(np.cumsum(sizes[near]), PAIRS)))
                some, near = near[:now], near[now:]
                if not len(some):
                    break
                flat = np.concatenate([sets[m] for m in some])
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
                for m in some[100 * both >= threshold * (sizes[some] + len(own) - both)]:
                    theirs = int(components[m])
                    if known.find(int(components[k])) != known.find(theirs):
                        known.join(int(components[k]), theirs)
                        out.append((int(ids[k]), int(ids[m])))
        return _links(out)
    return run


def _key(key: str, text: str) -> Column:
    """The id, or for a null id one of its text beyond all others."""
    return F.coalesce(column(key).cast("bigint"), F.shiftrightunsigned(F.xxhash64(column(text)), 2) + F.lit(1 << 62))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id (the least key reachable over links).

    Linked are documents with 100 * intersection >= threshold * union. A null, empty or wordless text has
    no shingles and no link. Repeated rows are copies; rows that repeat an id with another text count as
    one document with all their links. A null id is replaced by one above 2^62 made of its text; ids stay
    below that. An empty table gives no row, texts are read whole, other columns may have any name.
    """
    source = docs.select(_key(key, text).alias("id"), column(text).alias("text"))
    known = _settle_texts(source.mapInArrow(_sketch(words), _SKETCH))
    nodes = known.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"),
        F.first("key").alias("key"), F.first("low").alias("low"))
    nodes = settle(nodes)
    order = F.explode(F.array(*[F.lit(k) for k in range(ORDERS)]))
    orders = nodes.select("id", "n_shingles", "low", "key", order.alias("o")).select(
        F.concat(F.unhex(F.lpad(F.hex("o"), 2, "0")), F.substring("key", F.col("o") * (4 * DEPTH) + 1, F.lit(4 * DEPTH))).alias("sorted"),
        "low", "id", "n_shingles")
    seen = settle(orders.repartitionByRange("sorted", "id").sortWithinPartitions("sorted", "id").mapInArrow(
        _neighbours(threshold), "a bigint, b bigint, agreement int, region binary"))
    pairs = settle(seen.filter("b IS NOT NULL").groupBy("a", "b").agg(F.max("agreement").alias("agreement")))
    crowd = seen.filter("b IS NULL").select(F.col("a").alias("id"), "region").distinct()
    active = settle(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).unionAll(crowd.select("id")).distinct())

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())],
                ["id", "shingles"])

    sets = _settle_texts(join_small(source, active, ["id"], "left_semi", 32).mapInArrow(full, "id bigint, shingles binary"))
    links = settle(_confirmed(pairs, sets, threshold))
    labels = components(links)
    more = _crowded(settle(crowd), labels, sets, threshold)
    if more is not None:
        labels = settle(labels)
        joined = components(more)
        labels = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left").select(
            "id", F.coalesce("c", "component").alias("component")).unionAll(
            joined.join(labels, "id", "left_anti").select("id", "component"))
    return _labelled(known, nodes, labels).withColumnRenamed("id", key)


def _settle_texts(df: DataFrame) -> DataFrame:
    """Settle what tasks make of whole texts, few of them at a time."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(TEXTS))
    try:
        return settle(df)
    finally:
        conf.set(name, before)


def _labelled(known: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    labels = settle(labels.filter("id <> component"))
    copies = settle(nodes.filter("copies > 1").select("digest", F.col("id").alias("node")))
    rows = join_small(known.select("id", "n_shingles", "digest"), copies, ["digest"], "left", 128)
    rows = rows.withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("node", "id")).otherwise(F.col("id")))
    rows = join_small(rows, labels.withColumnRenamed("id", "node"), ["node"], "left", 64)
    return rows.select("id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links among the candidate pairs. Nodes are dealt into blocks, those with a common candidate of a candidate
    together, and a pair goes to the block pair of its nodes with their sets; no block pair is large."""
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = settle(ends.groupBy("id").agg(F.min("other").alias("label")).select("id", F.least("id", "label").alias("label")))
    # The label's own label, so that a large group falls into few labels and its nodes meet in few block pairs.
    label = settle(near.join(near.toDF("label", "next"), "label").select("id", F.col("next").alias("label")))
    held = sets.select("id", F.length("shingles").alias("bytes")).groupBy("id").agg(F.sum("bytes").alias("bytes"))
    sizes = label.join(held, "id").groupBy("label").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("parts"))
    blocks = settle(label.join(sizes, "label").select(
        "id", F.struct("label", F.pmod(F.xxhash64("id"), "parts").alias("part")).alias("block")))
    dealt = pairs.join(blocks.toDF("a", "ba"), "a").join(blocks.toDF("b", "bb"), "b").select(
        F.struct(F.least("ba", "bb").alias("x"), F.greatest("ba", "bb").alias("y")).alias("blocks"), "a", "b", "agreement")
    dealt = settle(dealt)
    need = dealt.select(F.col("blocks").alias("at"), F.col("a").alias("id")).unionAll(dealt.select("blocks", "b")).distinct()
    return dealt.groupBy("blocks").cogroup(need.join(sets, "id").groupBy("at")).applyInArrow(
        _confirm(threshold), "a bigint, b bigint")


def _crowded(crowd: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int) -> DataFrame | None:
    """Links between components inside crowded regions, as (a, b) of component ids; None if no region
    holds two components. Strays meet members in block pairs. In a region of more than LARGE_REGION nodes a
    stray meets only members of its own and the two next bands of set sizes; a band spans the ratio of sizes
    that a link allows, so no link is left out."""
    if crowd.isEmpty():
        return None
    rows = settle(crowd.select("id", "region").distinct().join(labels, "id", "left").select(
        "id", "region", F.coalesce("component", "id").alias("component")))
    parts = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    regions = settle(parts.groupBy("region").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("main")).filter(
        "parts > 1").select("region", F.col("main.component").alias("main"), (F.col("n") > LARGE_REGION).alias("large")))
    if regions.isEmpty():
        return None
    # A little wider than the ratio, so that rounding does not put a pair at the very ratio two bands apart.
    width = 1.001 * max(-math.log(max(threshold, 1) / 100), 0.01)
    sets = sets.filter(F.length("shingles") > 0)
    band = F.when(F.col("large"), F.floor(F.log(F.col("bytes") / 8) / width)).otherwise(0)
    # Once per size that a node has: an id that stands for several texts has several sets.
    rows = rows.join(regions, "region").join(sets.select("id", F.length("shingles").alias("bytes")), "id").groupBy(
        "region", "id", "component", "main", band.alias("band"), "large").agg(F.sum("bytes").alias("bytes"))
    near = F.when(F.col("large"), F.sequence(F.col("band") - 1, F.col("band") + 1)).otherwise(F.array("band"))
    rows = rows.select("region", "id", "component", (F.col("component") != F.col("main")).alias("stray"), "band", F.explode(near).alias("at"), "bytes")
    own = F.col("stray") & (F.col("at") == F.col("band"))
    sizes = rows.groupBy("region", "at").agg(
        F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("mine"), F.ceil(F.sum(F.when(own, F.col("bytes"))) / BLOCK_BYTES).alias("strays")).filter(
        "strays > 0")
    rows = settle(rows.join(settle(sizes), ["region", "at"]))
    deal = F.xxhash64("id")
    members = rows.select("region", "at", F.pmod(deal, "mine").alias("m"), F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("s"),
                          "id", "component", F.lit(False).alias("stray"))
    strays = rows.filter(own).select(
        "region", "at", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)).alias("m"), F.pmod(deal, "strays").alias("s"),
        "id", "component", F.lit(True).alias("stray"))
    blocks = members.unionAll(strays).join(sets, "id").groupBy("region", "at", "m", "s")
    found = settle(blocks.applyInArrow(_compare(threshold), "a bigint, b bigint").distinct())
    if found.isEmpty():
        return None
    comp = settle(labels).toDF("id", "c")
    ends = found.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    return ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, that of the least id, with the columns the documents came with.

    Of rows that repeat an id one stays, the one whose text hashes least. A row without words stays.
    """
    groups = settle(find(docs, key, text, **options).toDF("id", "n", "component"))
    (k,) = fresh(docs, "_id")
    columns = [column(c) for c in docs.columns]
    rows = docs.withColumn(k, _key(key, text))
    gone = settle(groups.filter("id <> component").select(F.col("id").alias(k)).distinct())
    rows = join_small(rows, gone, [k], "left_anti", 32)
    repeated = settle(groups.filter("id = component").groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(
        F.col("id").alias(k)))
    if repeated.isEmpty():
        return rows.select(*columns)
    single = join_small(rows, repeated, [k], "left_anti", 32)
    first = join_small(rows, repeated, [k], "left_semi", 32).groupBy(k).agg(
        F.min_by(F.struct(*columns), F.struct(F.xxhash64(column(text)), column(text))).alias(fresh(rows, "_row")[0]))
    return single.select(*columns).unionAll(first.select(f"{fresh(rows, '_row')[0]}.*"))
