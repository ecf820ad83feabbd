"""WARC files and their fixity: Merkle trees over ordered offset ranges of each replica.

A leaf is the hash of one record's stored bytes at its offset. Leaves are gathered by ranges of offsets,
ranges by FANOUT into wider ones up to one root per file, files by their name's hash into buckets, and
these into the root of the replica. An audit compares roots and goes down only where two nodes differ: a semi
join leaves the nodes of intact branches out of the comparison of the next level. The offsets are those of the manifest written with the files, so a damaged
record is still found where it stands.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm.common import column
from tallyshelf.llm.token_files import _get, _open, _put
from tallyshelf.session import settle

#: A file is closed at this size; a leaf range covers so many bytes; a node so many narrower ones.
FILE_BYTES, RANGE_BYTES, FANOUT = 16 * 1024 * 1024, 256 * 1024, 8
_MANIFEST = "file string, row bigint, offset bigint, length bigint, record_id string"


def record(url: str | None, body: str | None) -> tuple[str, bytes]:
    """Id and bytes of a page's response record. The id is made of the content, so it is the same each time."""
    address, payload = url or "", (body or "").encode("utf-8", "replace")
    id_ = str(uuid.UUID(hashlib.md5(address.encode("utf-8", "replace") + b"\0" + payload).hexdigest()))
    safe = " ".join(address.split())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{id_}>\r\nWARC-Target-URI: {safe}\r\n"
            f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\n"
            f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n")
    return id_, head.encode("utf-8", "replace") + http + payload + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write(pages: DataFrame, folder: str, url: str = "url", html: str = "html") -> None:
    """Write pages as part-PPPPPP-RRRR.warc.gz, one gzip member per record, each with its records' offsets
    in a .cdx file beside it, and the manifest (file, row, offset, length, record_id) of all files. Pages
    are written where they are read: nothing is shuffled.

    Null urls and bodies are empty, repeated rows are records of equal id, an empty table makes no file,
    bodies are written whole. A task holds one unfinished file. A task that is run again replaces its files.
    """
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, roll, members, entries, at = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{task:06d}-{roll:04d}.warc.gz"
            _put(folder, name, members)
            _put(folder, f"{name}.cdx", ["".join(json.dumps(e) + "\n" for e in entries).encode()])
            offsets, lengths, ids = zip(*entries)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(ids)], ["file", "row", "offset", "length", "record_id"])

        for batch in batches:
            for address, body in zip(batch.column(0), batch.column(1)):
                id_, data = record(address.as_py(), body.as_py())
                member = _member(data)
                members.append(member)
                entries.append((at, len(member), id_))
                at += len(member)
                if at >= FILE_BYTES:
                    yield close()
                    roll, members, entries, at = roll + 1, [], [], 0
        if entries:
            yield close()

    pages.select(column(url).cast("string").alias("url"), column(html).cast("string").alias("html")).mapInArrow(
        run, _MANIFEST).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return held.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def entries_of(folder: str, name: str) -> list[tuple[int, int, str]]:
    """Offset, length and id of the records of one file, in order."""
    return [tuple(json.loads(line)) for line in _get(folder, f"{name}.cdx").splitlines()]


def _known(folder: str, name: str) -> bool:
    """Whether a folder holds a file or its offsets."""
    fs, path = _open(folder)
    return any(x.type != pyarrow.fs.FileType.NotFound for x in fs.get_file_info([f"{path}/{name}", f"{path}/{name}.cdx"]))


def replicate(spark: SparkSession, source: str, target: str, change: Callable[[str, bytes, list], bytes | None] | None = None) -> None:
    """Copy the files of a folder to another. ``change`` (name, bytes, records) stands for what storage does
    to a file, in tests and drills; it returns the bytes that arrive, or None for no file."""
    fs, path = _open(target)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                data = _get(source, name)
                data = data if change is None else change(name, data, entries_of(source, name))
                if data is not None:
                    _put(target, name, [data])
            yield batch

    manifest(spark, source).select("file").distinct().mapInArrow(run, "file string").agg(F.count(F.lit(1))).collect()


def leaves(spark: SparkSession, folder: str, trusted: str) -> DataFrame:
    """Leaf (file, index, stop, record_id, hash) of each record, as this replica holds it at the offsets that
    the ``trusted`` folder, the one first written, has in its .cdx files.

    Bytes that a file lacks are left out of the hash, a missing file has no leaves, bytes beyond the last
    record are a leaf of their own without record, and so is the whole content of a file that the trusted
    folder does not have. Contents are hashed where they are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_py()
                known = _known(trusted, name)
                rows = [(at, at + length, id_) for at, length, id_ in entries_of(trusted, name)] if known else []
                end = max((stop for _, stop, _ in rows), default=0)
                if len(content) > end or not known:
                    rows.append((end, len(content), None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows)), pa.array([s for s, _, _ in rows], pa.int64()), pa.array([e for _, e, _ in rows], pa.int64()),
                     pa.array([i for _, _, i in rows], pa.string()),
                     pa.array([hashlib.sha256(b"%d:%d:" % (s, e) + content[s:e]).hexdigest() for s, e, _ in rows], pa.string())],
                    ["file", "index", "stop", "record_id", "hash"])

    return _files(spark, folder).mapInArrow(run, "file string, index bigint, stop bigint, record_id string, hash string")


class Tree:
    """A replica's tree as one table per level: leaves, ranges of a file, file roots, buckets of files, root."""

    def __init__(self, levels: list[DataFrame]):
        self.levels = levels


def tree(leaf_rows: DataFrame, length: int) -> Tree:
    """The tree over leaves, for files of at most ``length`` bytes, the same for replicas to be compared.

    Each level has (file, index, up_file, up_index, hash); a node's hash covers its children in order. A
    node gathers the leaves of one range, or FANOUT nodes.
    """
    up = F.floor(F.col("index") / RANGE_BYTES)
    levels = [settle(leaf_rows.withColumn("up_file", F.col("file")).withColumn("up_index", up))]
    spans = max(1, -(-length // RANGE_BYTES))
    while True:
        nodes = levels[-1].groupBy(F.col("up_file").alias("file"), F.col("up_index").alias("index")).agg(
            F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "index", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"))
        if spans > 1:
            spans = -(-spans // FANOUT)
            nodes = nodes.withColumn("up_file", F.col("file")).withColumn("up_index", F.floor(F.col("index") / FANOUT))
        elif spans == 1:  # these are file roots
            spans = 0
            nodes = nodes.withColumn("up_file", F.substring(F.md5("file"), 1, 3)).withColumn("up_index", F.lit(0).cast("bigint"))
        elif spans == 0:
            spans = -1
            nodes = nodes.withColumn("up_file", F.lit("")).withColumn("up_index", F.lit(0).cast("bigint"))
        else:
            levels.append(settle(nodes.withColumn("up_file", F.lit("")).withColumn("up_index", F.lit(0).cast("bigint"))))
            return Tree(levels)
        levels.append(settle(nodes))


def audit(a: Tree, b: Tree) -> DataFrame:
    """Rows (file, start, stop, record_id, kind) where replica ``b`` differs from ``a``; kind is changed,
    missing or extra. Equal roots end the audit; else each level joins only the children of nodes that
    differ. An empty result means equal replicas, two empty replicas are equal."""
    differ = None
    for x, y in zip(reversed(a.levels), reversed(b.levels)):
        if differ is not None:
            parents = F.broadcast(differ) if differ.count() <= 100_000 else differ
            x, y = (t.join(parents, ["up_file", "up_index"], "left_semi") for t in (x, y))
        both = x.alias("x").join(y.alias("y"), ["file", "index"], "full_outer").filter(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
        leaf = "stop" in x.columns
        if leaf:
            return both.select(
                "file", F.col("index").alias("start"), F.coalesce("x.stop", "y.stop").alias("stop"),
                F.coalesce("x.record_id", "y.record_id").alias("record_id"),
                F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("changed").alias("kind"))
        differ = settle(both.select(F.col("file").alias("up_file"), F.col("index").alias("up_index")))
    raise ValueError("a tree has no leaves")
